"""Language identification by rank-order profiles of n-grams.

A profile is the most frequent 1- to 3-grams of letters, in order of frequency; words are runs of
letters, lower-cased, with a blank before and after. A document's profile is compared with each
language's: for each n-gram of the document the distance is the difference of the two ranks, or
the profile's length where the language lacks it. The language with the least sum wins. Language
profiles are learned from all labelled documents that are passed to learn(); all of them are sent to all
tasks, LENGTH codes for each distinct label, so labels must be languages and not free text.

Defined results: null text and text without a letter give `und` and score 0, as does everything
if no language was learned; ties go to the first language in code point order; repeated rows each
get a row; empty tables give empty results; texts are read whole.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship

#: Length of the profiles.
LENGTH = 300
UNKNOWN = "und"
#: Grams gathered by a task before it sums them.
GATHERED = 2_000_000
SALTS = 64
PAIR, SINGLE = np.uint64(1 << 63), np.uint64(3 << 62)


@functools.cache
def letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def grams(text: str | None) -> np.ndarray:
    """Codes of all 1- to 3-grams of text, with repeats, as signed 64-bit numbers."""
    a = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    a = np.where(letter_table()[a], a, 0).astype(np.uint64)
    a = np.concatenate([[np.uint64(0)], a, [np.uint64(0)]])
    a = a[np.concatenate([[True], (a[1:] != 0) | (a[:-1] != 0)])]
    if len(a) < 3:
        return np.empty(0, dtype=np.int64)
    s = np.uint64(21)
    pairs = (a[:-1] << s) | a[1:]
    three = ((pairs[:-1] << s) | a[2:])[a[1:-1] != 0]
    return np.concatenate([a[a != 0] | SINGLE, pairs | PAIR, three]).view(np.int64)


def profile(codes: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The most frequent codes, in order; ties by code."""
    found, n = np.unique(codes, return_counts=True)
    return found[np.argsort(-n, kind="stable")[:length]]


def count_batches(batches):
    """For mapInArrow: (lang, text) to partial counts (lang, gram, n)."""
    kept: dict[str, list[np.ndarray]] = {}
    size = 0

    def flush():
        for lang, parts in kept.items():
            found, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            part = batch.slice(i, 64)
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                codes = grams(text)
                kept.setdefault(lang, []).append(codes)
                size += len(codes)
            if size > GATHERED:
                yield from flush()
                kept.clear()
                size = 0
    yield from flush()


def learn(docs: DataFrame, lang: str = "lang", text: str = "text", length: int = LENGTH) -> dict[str, list[int]]:
    """Profiles by language from all rows with both; at most `length` codes for each language reach the driver."""
    ship(docs.sparkSession)
    d = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    n = d.mapInArrow(count_batches, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = lambda frame, *by: frame.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= length)
    n = best(n.withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(SALTS))), "lang", "salt").drop("salt", "rank")
    out: dict[str, list[int]] = {}
    for r in sorted(best(n, "lang").collect(), key=lambda r: (r["lang"].encode(), r["rank"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


class Profiles:
    """Distances of a document to all languages at once."""

    def __init__(self, learned: dict[str, list[int]], length: int = LENGTH):
        self.languages = sorted(learned, key=str.encode)
        self.length = length
        self.codes = np.unique(np.array([g for p in learned.values() for g in p], dtype=np.int64))
        self.ranks = np.full((len(self.languages), len(self.codes) + 1), -1, dtype=np.int64)
        for i, x in enumerate(self.languages):
            self.ranks[i, np.searchsorted(self.codes, np.array(learned[x], dtype=np.int64))] = np.arange(len(learned[x]))

    def predict(self, text: str | None) -> tuple[str, float]:
        p = profile(grams(text), self.length)
        if not len(p) or not self.languages:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.codes, p)
        known = (at < len(self.codes)) & (self.codes[np.minimum(at, len(self.codes) - 1)] == p)
        ranks = self.ranks[:, np.where(known, at, len(self.codes))]
        away = np.where(ranks >= 0, np.abs(ranks - np.arange(len(p))), self.length).sum(axis=1)
        best = int(np.argmin(away))
        return self.languages[best], float(1 - away[best] / (self.length * len(p)))


def predict(docs: DataFrame, learned: dict[str, list[int]], text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, lang_pred, score); keep names columns of docs that go along."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(learned)
    names = [key, *keep]

    def run(batches):
        profiles = Profiles(shared.value)
        for batch in batches:
            found = [profiles.predict(batch.column(len(names))[i].as_py()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(names))), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())],
                [*names, "lang_pred", "score"],
            )

    d = docs.select(*names, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:-1])
    return d.mapInArrow(run, f"{schema}, lang_pred string, score double")
