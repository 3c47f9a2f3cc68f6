import pytest

from tensorloom.llm import token_counts as T
from tensorloom.llm.common import new_folder

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string"
TEXTS = [None, "", "   ", "Hello  world", " Hello\tworld\n", "don't 's I'm", "x<|endoftext|>y <|startoftext|> <|endoftext |>", "é é ﬁ Σας ß x y", "a\x1cb a\x85b", "中文 字 123abc !!! … 👍🏽", "word " * 30000, "x" * 5000, "a\x00b"]


def library(name, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(P.path(name)))
    return [len(x.ids) for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name,separable", [("word_bpe_49k.json", True), ("word_bpe_49k.json", False), ("byte_bpe_50k.json", False)])
def test_counts_are_the_library_s(spark, name, separable):
    d = spark.createDataFrame(list(enumerate(TEXTS)), SCHEMA).selectExpr("*", "1 AS digest", "'x' AS content", "2 AS n_tokens")
    got = T.token_counts(d, str(P.path(name)), new_folder(spark, "cache"), separable=separable).collect()
    assert [r.n_tokens for r in sorted(got)] == library(name, TEXTS)
    assert [r.n_bytes for r in sorted(got)] == [len((t or "").encode()) for t in TEXTS]


def test_only_misses_are_encoded_and_appended(spark):
    path, cache = str(P.path("word_bpe_49k.json")), new_folder(spark, "cache")
    one = spark.createDataFrame([(1, "a b"), (2, "a  b"), (3, "c"), (3, "c"), (None, "c d e")], SCHEMA)
    T.token_counts(one, path, cache, separable=True).collect()
    stored = T.open_cache(spark, cache)
    assert stored.count() == 3  # "a b" and "a  b" share a key
    two = spark.createDataFrame([(7, "c"), (8, "new words"), (9, None)], SCHEMA)
    got = {r.doc_id: r.n_tokens for r in T.token_counts(two, path, cache, separable=True).collect()}
    assert got == {7: 1, 8: 2, 9: 0} and T.open_cache(spark, cache).count() == 5
    # counts are taken from the cache: a planted one comes back
    version = T.version_of(path, True)
    planted = T.open_cache(spark, cache).where("false")
    from pyspark.sql import functions as F

    row = two.where("doc_id = 8").select(F.lit(version).alias("version"), F.unhex(F.sha2(F.encode(F.lit("planted"), "utf-8"), 256)).alias("digest"), F.lit(99).cast("long").alias("n_tokens"))
    planted.union(row).write.mode("append").parquet(cache)
    three = spark.createDataFrame([(1, " planted ")], SCHEMA)
    assert T.token_counts(three, path, cache, separable=True).collect()[0].n_tokens == 99
    # another version does not see it
    assert T.token_counts(three, path, cache, separable=False).collect()[0].n_tokens != 99


def test_rows_with_one_id_and_different_texts(spark):
    d = spark.createDataFrame([(1, "a"), (1, "b c"), (1, "b c"), (None, "d e f"), (None, "g")], SCHEMA)
    got = sorted(r.n_tokens for r in T.token_counts(d, str(P.path("word_bpe_49k.json")), new_folder(spark, "cache"), separable=True).collect())
    assert got == [1, 1, 2, 2, 3]


def test_empty_table(spark):
    cache = new_folder(spark, "cache")
    assert T.token_counts(spark.createDataFrame([], SCHEMA), str(P.path("word_bpe_49k.json")), cache, separable=True).count() == 0
    assert T.open_cache(spark, cache).count() == 0


def test_a_full_memory_of_words_keeps_counts_right(spark, monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 2)
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        count = T.counter(f.read(), True)
    texts = ["one two three", "two three four", "five one", "one two three four five six", ""] * 3
    assert count(texts) == [n for t in texts for n in count([t])] == library("word_bpe_49k.json", texts)


def test_texts_without_ids_are_no_cross_product(spark):
    """A miss meets its text by id and digest, so rows that share an id or have none don't meet each other."""
    d = spark.createDataFrame([(None, f"text {i}") for i in range(300)] + [(5, f"text {i} more") for i in range(300)], SCHEMA)
    cache = new_folder(spark, "cache")
    got = T.token_counts(d, str(P.path("word_bpe_49k.json")), cache, separable=True)
    texts = [r.text for r in d.collect()]
    assert sorted(r.n_tokens for r in got.collect()) == sorted(library("word_bpe_49k.json", texts))
    assert T.open_cache(spark, cache).count() == 600


def test_query_counts_are_the_library_s(spark):
    """The query over the whole small table against the library."""
    from tensorloom.llm.queries import queries, table

    d = "/root/testdata/sf0.001"
    rows = table(spark, d, "documents").collect()
    want = sorted(zip([r.doc_id for r in rows], library("word_bpe_49k.json", [r.text for r in rows]), strict=True))
    got = queries()["op2_digest_cache"](spark, d).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == want and all(r.over_limit == (r.n_tokens > 2048) for r in got)
