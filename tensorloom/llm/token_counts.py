"""Token counts through a digest cache.

The cache is a table (version, digest, n_tokens) in the shared folder. A text's key is the SHA-256
of its normalised content; the version is the SHA-256 of the tokenizer's file, the library's
version and the options. Counts that are stored for a key are joined; of the other texts one for
each key is encoded, and the new counts are appended.

Normalised content is the text itself, null being empty. Where the tokenizer drops white space
(`separable`), runs of U+0009 to U+000D and space count as one space, and words between them are
encoded one by one and remembered: no token of such a tokenizer crosses a space.

Defined results: null or empty text has 0 bytes and 0 tokens; repeated rows each get a row and
share a key; null ids are kept; an empty table gives an empty result and an unchanged cache.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SEPARATORS, ship, stage

CACHE_SCHEMA = "version string, digest binary, n_tokens long"
#: Words in each of the two generations that a worker remembers.
REMEMBERED = 800_000
#: Counters of this worker by version; they live on from task to task.
COUNTERS: dict = {}


def version_of(path: str, separable: bool) -> str:
    import tokenizers

    with open(path, "rb") as f:
        content = f.read()
    return hashlib.sha256(content + f"|tokenizers {tokenizers.__version__}|{separable}".encode()).hexdigest()


def normalised(text: Column, separable: bool) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.trim(F.regexp_replace(t, SEPARATORS, " "), F.lit(" ")) if separable else t


def counter(definition: str, separable: bool):
    """A function from a list of normalised texts to their token counts."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    encode = lambda texts: [len(x.ids) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    if not separable:
        return encode
    def encode_words(words: list[str], chunk: int = 500) -> list[int]:
        """Counts of single words; many share one call, whose tokens tell their words."""
        parts = [words[i : i + chunk] for i in range(0, len(words), chunk)]
        found = tokenizer.encode_batch(parts, is_pretokenized=True, add_special_tokens=False)
        return [n for p, e in zip(parts, found, strict=True) for n in np.bincount(np.array(e.word_ids, dtype=np.int64), minlength=len(p)).tolist()]

    young: dict[str, int] = {}
    old: dict[str, int] = {}

    def count(texts: list[str]) -> list[int]:
        nonlocal young, old
        parts = [t.split(" ") if t else [] for t in texts]
        if len(young) > REMEMBERED:
            young, old = {}, young
        missing = [w for w in set().union(*parts) if w not in young]
        young.update((w, old[w]) for w in missing if w in old)
        new = [w for w in missing if w not in old]
        if new:
            young.update(zip(new, encode_words(new), strict=True))
        look = young.__getitem__
        return [sum(map(look, p)) for p in parts]

    return count


def encode_batches(definition, version: str, separable: bool, rows: int = 64):
    """For mapInArrow: (digest, content) to (digest, n_tokens)."""

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if version not in COUNTERS:
            COUNTERS.clear()
            COUNTERS[version] = counter(definition.value, separable)
        count = COUNTERS[version]
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                n = count(part.column("content").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    return run


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; an empty table where there is none yet."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        spark.createDataFrame([], CACHE_SCHEMA).write.mode("ignore").parquet(path)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, text: str = "text", key: str = "doc_id", separable: bool = False) -> DataFrame:
    """(key, n_bytes, n_tokens, digest) for each row of docs; extends the cache at cache_path."""
    spark = docs.sparkSession
    ship(spark)
    version = version_of(tokenizer_path, separable)
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())

    digest = F.unhex(F.sha2(F.encode(normalised(F.col("text"), separable), "utf-8"), 256))
    d = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    n_bytes = F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long")
    keys = stage(d.select("id", n_bytes.alias("n_bytes"), digest.alias("digest")), "token-keys")

    cached = open_cache(spark, cache_path).where(F.col("version") == version).select("digest", "n_tokens")
    # the smallest id stands for all texts of one digest
    misses = keys.join(cached, "digest", "left_anti").groupBy("digest").agg(F.min("id").alias("first"))
    texts = (
        d.join(misses.hint("shuffle_hash"), d["id"].eqNullSafe(misses["first"]))
        .select("digest", digest.alias("own"), normalised(F.col("text"), separable).alias("content"))
        .where(F.col("own") == F.col("digest"))
        .select("digest", "content")
    )
    counted = texts.mapInArrow(encode_batches(definition, version, separable), "digest binary, n_tokens long")
    # rows repeated in full would store a key more than once
    counted = counted.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counted.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache_path)

    counts = open_cache(spark, cache_path).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return keys.join(counts, "digest").select(F.col("id").alias(key), "n_bytes", "n_tokens", "digest")
