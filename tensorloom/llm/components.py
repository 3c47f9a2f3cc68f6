"""Connected components of an edge table by alternating large and small stars.

A table of at most FEW edges, by a count, is done by union-find in one task of an executor instead:
rounds over so few edges cost more than the work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, stage


FEW = 200_000


def forest(table: pa.Table) -> pa.Table:
    """For applyInArrow: edges (u, v) to (node, root), by union-find with the smaller root kept."""
    nodes, at = np.unique(np.concatenate([table.column("u").to_numpy(), table.column("v").to_numpy()]), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    n = table.num_rows
    for a, b in zip(at[:n].tolist(), at[n:].tolist(), strict=True):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    roots = np.array([find(i) for i in range(len(nodes))], dtype=np.int64)
    return pa.table({"node": pa.array(nodes, pa.int64()), "root": pa.array(nodes[roots], pa.int64())})


def components(edges: DataFrame, most: int = 100) -> DataFrame:
    """(u, v) long edges to (node, root): the smallest node that links reach, for every node with an edge.

    Each round links the neighbours of a node to the least of them, first those above it, then
    those below, until nothing changes; the number of rounds grows with the logarithm of the
    number of nodes. Rounds are written to the shared folder. More than `most` rounds are an error:
    what stands then is no answer.
    """
    spark = edges.sparkSession
    e = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    if e.count() <= FEW:
        out = stage(e.groupBy(F.lit(0).alias("all")).applyInArrow(forest, "node long, root long"), "components")
        drop_staged(spark, e)
        return out
    mark = None
    for _ in range(most):
        both = e.union(e.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = stage(small, "edges")
        drop_staged(spark, e)
        e = new
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0])
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"links still change after {most} rounds")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
