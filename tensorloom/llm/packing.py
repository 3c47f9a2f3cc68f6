"""Optimal length buckets and batches of a token budget.

Dynamic programming over the histogram of lengths, each distinct length by itself, chooses at most
`buckets` upper bounds so that the padding, upper bound minus length summed over all documents, is
least. W words in all have less than sqrt(2 W) + 1 distinct lengths, so the driver holds few. Inside each bucket batches hold as many
documents as fit the budget when each is padded to the bucket's bound; a document longer than the
budget is a batch of its own. Nothing is truncated.

Documents are numbered within a bucket by slices (by digest), so no bucket is gathered in one task.

Defined results: null or blank text has length 0; repeated rows are documents of their own; an
empty table gives an empty result; rows of one null or repeated id and one length are numbered in one
window, on rows that it can spill; lengths are words, so the token budget is one of words; pack() keeps other columns and returns its own under the names
in COLUMNS, in place of columns so named.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import n_words

BUCKETS = 16
BUDGET = 65_536
#: About this many documents are numbered by one window.
SLICE_ROWS = 20_000
COLUMNS = ("length", "bucket", "bucket_length", "batch", "padding")


def boundaries(tops, counts, totals, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds that minimise padding; tops ascending, counts and summed lengths for each bin.

    best[j] after k rounds is the least padding of the first j bins in k buckets. The cost of a
    bucket satisfies the quadrangle inequality, so the best split moves to the right with j and
    divide and conquer applies.
    """
    m = len(tops)
    if not m:
        return []
    tops = np.asarray(tops, dtype=np.float64)
    n = np.concatenate([[0.0], np.cumsum(np.asarray(counts, dtype=np.float64))])
    s = np.concatenate([[0.0], np.cumsum(np.asarray(totals, dtype=np.float64))])

    def cost(i, j):  # bins i to j - 1 in one bucket; i may be an array
        return tops[j - 1] * (n[j] - n[i]) - (s[j] - s[i])

    best = np.array([0.0] + [cost(0, j) for j in range(1, m + 1)])
    splits = [np.zeros(m + 1, dtype=np.int64)]
    for _ in range(1, min(buckets, m)):
        new, split = best.copy(), np.zeros(m + 1, dtype=np.int64)
        todo = [(1, m, 0, m - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(a, min(mid - 1, b) + 1)
            total = best[i] + cost(i, mid)
            k = int(np.argmin(total))
            new[mid], split[mid] = total[k], i[k]
            todo += [(lo, mid - 1, a, int(i[k])), (mid + 1, hi, int(i[k]), b)]
        best = new
        splits.append(split)
    out, j = [], m
    for split in reversed(splits):
        if j == 0:
            break
        out.append(int(tops[j - 1]))
        j = int(split[j])
    return sorted(out)


def length_bounds(docs: DataFrame, length: Column, buckets: int = BUCKETS) -> tuple[list[int], int]:
    """Bounds of the buckets, and the number of documents."""
    rows = sorted(docs.select(length.alias("length")).groupBy("length").agg(F.count("*").alias("n")).collect())
    found = boundaries([r["length"] for r in rows], [r["n"] for r in rows], [r["length"] * r["n"] for r in rows], buckets)
    return found, sum(r["n"] for r in rows)


def pack(docs: DataFrame, length: Column | None = None, key: str = "doc_id", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """docs with length, bucket (from 0), bucket_length, batch (unique, from 0 in each bucket) and padding.

    length is the number of words of `text` unless given, for example from token_counts. Columns of
    docs keep their names; names that begin with __pack_ are used here.
    """
    length = n_words(F.col("text")) if length is None else F.coalesce(length.cast("long"), F.lit(0))
    bounds, n_docs = length_bounds(docs, length, buckets)
    slices = max(1, -(-n_docs // SLICE_ROWS))
    rest = [c for c in docs.columns if c not in COLUMNS]
    digest = F.xxhash64(F.col(key))
    d = docs.select(*rest, length.alias("__pack_length"), digest.alias("__pack_digest"), F.col(key).alias("__pack_key"))
    edges = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast(T.ArrayType(T.LongType()))
    # a sum, not a lambda over edges: a lambda would count the words anew for each edge
    bucket = sum(((F.col("__pack_length") > b).cast("int") for b in bounds), F.lit(0))
    # null and repeated ids are dealt by length too
    slice_ = F.pmod(F.xxhash64("__pack_digest", "__pack_length"), F.lit(slices))
    d = d.withColumns({"__pack_bucket": bucket, "__pack_slice": slice_})
    counts = d.groupBy("__pack_bucket", "__pack_slice").agg(F.count("*").alias("__pack_n"))
    before = Window.partitionBy("__pack_bucket").orderBy("__pack_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("__pack_bucket", "__pack_slice", F.coalesce(F.sum("__pack_n").over(before), F.lit(0)).alias("__pack_base"))
    inside = Window.partitionBy("__pack_bucket", "__pack_slice").orderBy("__pack_digest", "__pack_key", "__pack_length")
    d = d.withColumn("__pack_rank", F.row_number().over(inside)).join(counts, ["__pack_bucket", "__pack_slice"], "left")
    top = F.coalesce(F.element_at(edges, F.col("__pack_bucket") + 1), F.lit(0).cast("long"))
    each = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(top, F.lit(1))))
    return d.select(
        *rest,
        F.col("__pack_length").alias("length"),
        F.col("__pack_bucket").alias("bucket"),
        top.alias("bucket_length"),
        F.floor((F.col("__pack_base") + F.col("__pack_rank") - 1) / each).cast("long").alias("batch"),
        (top - F.col("__pack_length")).alias("padding"),
    )
