"""Mixing of sources to target weights by systematic sampling.

Within a source the documents stand in order of size; each has the same expected number of
copies, target / source size, so the prefix sum at rank i is i times that. One offset is added
and a document is emitted once for each integer boundary that its step crosses. The order by
size makes neighbours alike, so the taken words stay near the target.

Ranks are found without gathering a source in one task: distinct sizes of a source are summed
first, then slices (by digest) of documents of one source and size, and only documents that
share source, size and slice are numbered in one window.

Defined results: null text or size counts 0 words; a null source is a source of its own, last in
order; repeated rows are documents of their own; an empty table gives an empty result; columns
of other names pass through mix(), which uses names with the prefix __mix_ for itself. All rows of
a null id are ranked in one window for each source and size, on narrow rows that it can spill; mix() gathers the
copies of rows that are alike in id and text as one array of small numbers, and numbers them in one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, stage

#: Weights by position of the source in code point order, repeating.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SLICES = 256


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, target): one row for each source.

    Targets are shares by weight of `share` times all sizes, capped at `most` times the source's
    size, the excess being shared again by weight until none is above its cap. That is filling
    to a common level: in order of cap / weight a prefix of the sources is capped, and the others
    share what is left by weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    s = sizes.select("source", "source_size", F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))).alias("k"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("k") + 1)
    s = s.select("source", "source_size", w.alias("w"), (F.lit(float(most)) * F.col("source_size")).alias("cap"))
    order = [F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    s = s.select(
        "*",
        F.row_number().over(Window.orderBy(*order)).alias("at"),
        (F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("left"),
        (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))).alias("w_left"),
    )
    s = s.select("*", (F.col("cap") * F.col("w_left") <= F.col("left") * F.col("w")).alias("capped"))
    first = F.min(F.when(~F.col("capped"), F.struct("at", "left", "w_left"))).over(every)
    s = s.select("*", first.alias("first"))
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("w") * F.col("first.left") / F.col("first.w_left"))
    return s.select("source", "source_size", target.cast("double").alias("target"))


def offset(source: Column, seed: str) -> Column:
    """One number in [0, 1) for each source, the same on each run; 16 bits, so that ranks below 2^36 add to it exactly."""
    digest = F.md5(F.encode(F.concat(F.lit(seed + ":"), F.coalesce(source, F.lit(""))), "utf-8"))
    return F.conv(F.substring(digest, 1, 4), 16, 10).cast("double") / 65536.0


def plan(docs: DataFrame, source: str = "source", size: Column | None = None, key: str = "doc_id", text: str | None = "text", seed: str = "mix") -> DataFrame:
    """One narrow row for each row of docs: __mix_key, __mix_rid (of id and text), __mix_source, __mix_size, __mix_source_size, __mix_target, __mix_copies (int, 0 to 2).

    Of documents with one id, source and size the order is by a digest of their texts. Sizes are
    counted once and written to the shared folder.
    """
    size = n_words(F.col("text")) if size is None else F.coalesce(size.cast("long"), F.lit(0))
    rid = F.xxhash64(F.col(key), F.col(text)) if text in docs.columns else F.xxhash64(F.col(key))
    d = stage(docs.select(F.col(key).alias("__mix_key"), rid.alias("__mix_rid"), F.col(source).alias("__mix_source"), size.alias("__mix_size")), "sizes")
    digest = F.md5(F.encode(F.coalesce(F.col("__mix_key").cast("string"), F.lit("")), "utf-8"))
    d = d.withColumn("__mix_digest", digest).withColumn("__mix_slice", F.conv(F.substring("__mix_digest", 1, 2), 16, 10).cast("int"))

    small = d.select(F.col("__mix_source").alias("source"), F.col("__mix_size").alias("size"), F.col("__mix_slice").alias("slice"))
    slices = small.groupBy("source", "size", "slice").agg(F.count("*").alias("n"))
    sizes = small.groupBy("source", "size").agg(F.count("*").alias("n"))
    totals = sizes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    up_to = lambda *order: Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("source", "size", F.coalesce(F.sum("n").over(up_to("size").partitionBy("source")), F.lit(0)).alias("__mix_base"))
    slices = slices.select(
        "source", "size", "slice", F.coalesce(F.sum("n").over(up_to("slice").partitionBy("source", "size")), F.lit(0)).alias("__mix_in_size")
    )
    t = targets(totals).select("source", F.col("source_size").alias("__mix_source_size"), F.col("target").alias("__mix_target"))

    order = [F.col("__mix_digest"), F.col("__mix_key"), F.col("__mix_rid")]
    d = d.withColumn(
        "__mix_in_slice",
        F.row_number().over(Window.partitionBy("__mix_source", "__mix_size", "__mix_slice").orderBy(*order)),
    )
    for frame, names in ((slices, ("source", "size", "slice")), (sizes, ("source", "size")), (t, ("source",))):
        found = [frame[c] for c in frame.columns if c.startswith("__mix_")]
        d = d.join(frame, [d[f"__mix_{n}"].eqNullSafe(frame[n]) for n in names], "left").select(*[d[c] for c in d.columns], *found)
    size, target = F.col("__mix_source_size"), F.col("__mix_target")
    rate = F.when(size > 0, target / size).otherwise(F.lit(0.0))
    rank = F.col("__mix_base") + F.col("__mix_in_size") + F.col("__mix_in_slice")
    d = d.withColumns({"__mix_rank": rank, "__mix_rate": rate, "__mix_u": offset(F.col("__mix_source"), seed)})
    up_to_rank = lambda i: F.floor(i * F.col("__mix_rate") + F.col("__mix_u"))
    crossed = up_to_rank(F.col("__mix_rank")) - up_to_rank(F.col("__mix_rank") - 1)
    return d.select("__mix_key", "__mix_rid", "__mix_source", "__mix_size", "__mix_source_size", "__mix_target", F.least(crossed, F.lit(MOST)).cast("int").alias("__mix_copies"))


def mix(docs: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """The mixed corpus: each row of docs as many times as it is taken, with the columns of docs.

    Ranks are found on narrow rows; texts are moved once. Rows repeated in id and text share out their copies
    in the order of their other columns' digest.
    """
    found = plan(docs, source, key=key, text=text).groupBy("__mix_rid").agg(F.sort_array(F.collect_list("__mix_copies"), asc=False).alias("__mix_each"))
    found = stage(found.where(F.element_at("__mix_each", 1) > 0), "copies")
    again = lambda n: F.explode(F.array_repeat(F.lit(1), n)).alias("__mix_copy")
    some = docs.withColumn("__mix_rid", F.xxhash64(F.col(key), F.col(text)))
    taken = lambda f: some.join(f.hint("shuffle_hash"), "__mix_rid")
    one = F.size("__mix_each") == 1
    out = taken(found.where(one)).select(*docs.columns, again(F.element_at("__mix_each", 1)))
    if found.where(~one).take(1):
        rest = [c for c, t in docs.dtypes if not t.startswith("map")]
        order = Window.partitionBy("__mix_rid").orderBy(F.xxhash64(*rest))
        many = taken(found.where(~one)).withColumn("__mix_i", F.row_number().over(order))
        out = out.unionAll(many.select(*docs.columns, again(F.element_at("__mix_each", F.col("__mix_i")))))
    return out.select(*docs.columns)
