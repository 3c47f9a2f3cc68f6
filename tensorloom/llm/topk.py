"""Exact top-k search by inner product with ball trees.

The vectors are dealt to shards; a ball tree (centre and radius for each node) is built of each shard
once and written to the shared folder as a row, and so are the queries in blocks. Trees meet blocks by
a join; a tree answers a block by branch and bound: a node's inner products are at most
q.centre + |q| * radius, nodes are visited in descending order of that bound, and a query stops at
nodes whose bound is below its current kth score. That score is shared: a first round in which
each shard looks only into each query's most promising leaf gives every query a kth score over
all shards, with which the second round starts, so that it returns few rows beside the answers.

Trees are dealt to GROUPS groups and each block is sent to each group once; no vector passes through
the driver, and a task holds one tree and one block at a time.

Defined results: vectors that are null, empty or hold null or non-finite components take no part;
vectors are compared with those of their own length only; ties go to the smaller id; rows that share an
id are queries and candidates of their own, and a query leaves out one row only, its own (of rows alike
in id and vector it doesn't matter which); empty tables give empty results. Scores that may not fit
into 2^53, where doubles stop being exact, are an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_staged, ship, stage

BLOCK = 4096
GROUPS = 64
LEAF = 128
#: Rows of a shard.
SHARD = 16_384
FOUND = "query_id long, vec_id long, score long"


class BallTree:
    """Nodes in arrays; children of i are 2 i + 1 and 2 i + 2, leaves at the last level."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.levels = max(0, int(np.ceil(np.log2(max(1, len(ids)) / leaf))))
        parts = [order]
        self.centre, self.radius = [], []
        for level in range(self.levels + 1):
            self.centre.append(np.stack([x[p].mean(axis=0) for p in parts]))
            self.radius.append(np.array([np.sqrt(((x[p] - c) ** 2).sum(axis=1).max()) for p, c in zip(parts, self.centre[-1], strict=True)]))
            if level < self.levels:
                parts = [half for p, c in zip(parts, self.centre[-1], strict=True) for half in self.split(p, x[p], c)]
        self.leaves = parts
        self.ids, self.x = ids, x

    def to_row(self) -> dict:
        """The tree as binary columns; vectors stand in the order of the leaves."""
        order = np.concatenate(self.leaves)
        sizes = np.array([len(p) for p in self.leaves], dtype=np.int64)
        arrays = {"ids": self.ids[order], "x": self.x[order], "sizes": sizes, "centre": np.concatenate(self.centre), "radius": np.concatenate(self.radius)}
        return {k: np.ascontiguousarray(v).tobytes() for k, v in arrays.items()}

    @classmethod
    def of_row(cls, row: dict, dim: int) -> BallTree:
        of = lambda k, kind=np.float64: np.frombuffer(row[k], dtype=kind)
        tree = cls.__new__(cls)
        tree.ids, tree.x = of("ids", np.int64), of("x").reshape(-1, dim)
        ends = np.cumsum(of("sizes", np.int64))
        tree.leaves = [np.arange(b - n, b) for b, n in zip(ends.tolist(), of("sizes", np.int64).tolist(), strict=True)]
        tree.levels = len(tree.leaves).bit_length() - 1
        cuts = [(1 << level) - 1 for level in range(tree.levels + 2)]
        centre, radius = of("centre").reshape(-1, dim), of("radius")
        tree.centre = [centre[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        tree.radius = [radius[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return tree

    @staticmethod
    def split(part: np.ndarray, x: np.ndarray, centre: np.ndarray) -> list[np.ndarray]:
        """Halves by the direction between two points far from each other."""
        a = x[np.argmax(((x - centre) ** 2).sum(axis=1))]
        b = x[np.argmax(((x - a) ** 2).sum(axis=1))]
        by = np.argsort(x @ (a - b), kind="stable")
        return [part[by[: len(by) // 2]], part[by[len(by) // 2 :]]]

    def check(self, norms: np.ndarray) -> None:
        """Every partial sum of a score is at most the product of two norms."""
        longest = np.sqrt((self.centre[0][0] ** 2).sum()) + self.radius[0][0]
        if norms.max(initial=0.0) * longest >= 2.0**53:
            raise ValueError("inner products of these vectors may exceed 2^53")

    def bounds(self, level: int, q: np.ndarray, norms: np.ndarray) -> np.ndarray:
        up = q @ self.centre[level].T + norms[:, None] * self.radius[level]
        return up + 1e-9 * np.abs(up) + 1e-6  # rounding must not lower a bound


class Best:
    """The k best (score, smaller id first) of each query of a block."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, kth: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k  # ids of queries, which candidates don't have
        self.norms = np.sqrt((q**2).sum(axis=1))
        self.least = kth.astype(np.float64).copy()
        self.score = np.full((len(ids), k), -np.inf)
        self.vec = np.full((len(ids), k), np.iinfo(np.int64).max)

    def look(self, tree: BallTree, leaf: int, rows: np.ndarray) -> None:
        """Score the leaf's rows for some queries. Integers below 2^53 are exact in doubles."""
        at = tree.leaves[leaf]
        s = self.q[rows] @ tree.x[at].T
        ids = np.broadcast_to(tree.ids[at], s.shape)
        s = np.concatenate([self.score[rows], s], axis=1)
        v = np.concatenate([self.vec[rows], ids], axis=1)
        order = np.lexsort((v, -s), axis=1)[:, : self.k]
        self.score[rows] = np.take_along_axis(s, order, axis=1)
        self.vec[rows] = np.take_along_axis(v, order, axis=1)
        self.least[rows] = np.maximum(self.least[rows], self.score[rows, -1])

    def probe(self, tree: BallTree) -> None:
        """Look into each query's most promising leaf."""
        first = np.argmax(tree.bounds(tree.levels, self.q, self.norms), axis=1)
        for leaf in np.unique(first):
            self.look(tree, int(leaf), np.flatnonzero(first == leaf))

    def search(self, tree: BallTree) -> None:
        """Branch and bound: levels are pruned top-down, leaves visited by descending bound."""
        alive = np.ones((len(self.ids), 1), dtype=bool)
        up = None
        for level in range(tree.levels + 1):
            if level:
                alive, up = np.repeat(alive, 2, axis=1), np.repeat(up, 2, axis=1)
            own = tree.bounds(level, self.q, self.norms)
            up = own if up is None else np.minimum(up, own)
            alive &= up >= self.least[:, None]
            if not alive.any():
                return
        up = np.where(alive, up, -np.inf)
        order = np.argsort(-up, axis=1, kind="stable")
        for step in range(order.shape[1]):
            leaf = order[:, step]
            open_ = np.flatnonzero((up[np.arange(len(leaf)), leaf] >= self.least) & np.isfinite(up[np.arange(len(leaf)), leaf]))
            if not len(open_):
                return
            for x in np.unique(leaf[open_]):
                self.look(tree, int(x), open_[leaf[open_] == x])

    def rows(self) -> pa.RecordBatch:
        real = np.isfinite(self.score)
        q = np.broadcast_to(self.ids[:, None], real.shape)[real]
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(self.vec[real], pa.int64()), pa.array(self.score[real].astype(np.int64), pa.int64())], ["query_id", "vec_id", "score"])


def shards(batches, rows: int):
    """(ids, matrix) for at most `rows` vectors of one length."""
    held: dict[int, list] = {}
    for batch in batches:
        v = batch.column("v")
        lengths = np.diff(np.asarray(v.offsets))
        flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            x = flat[starts[at][:, None] + np.arange(n)]
            for i in range(0, len(at), rows):
                part = held.setdefault(int(n), [])
                part.append((ids[at[i : i + rows]], x[i : i + rows]))
                if sum(len(p[0]) for p in part) >= rows:
                    yield np.concatenate([p[0] for p in part]), np.concatenate([p[1] for p in part])
                    held[int(n)] = []
    for part in held.values():
        if part:
            yield np.concatenate([p[0] for p in part]), np.concatenate([p[1] for p in part])


TREE = {"ids": pa.binary(), "x": pa.binary(), "sizes": pa.binary(), "centre": pa.binary(), "radius": pa.binary()}


def build_trees(groups: int):
    """For mapInArrow: (id, v) to trees of the task's vectors, dealt to groups."""

    def run(batches):
        made = TaskContext.get().partitionId()
        for ids, x in shards(batches, SHARD):
            row = BallTree(ids, x).to_row()
            yield pa.RecordBatch.from_arrays([pa.array([made % groups], pa.int32()), pa.array([x.shape[1]], pa.int32()), *(pa.array([row[k]], t) for k, t in TREE.items())], ["g", "dim", *TREE])
            made += 1

    return run


def build_blocks(size: int):
    """For mapInArrow: (id, v) of queries, v with the kth score so far behind, to blocks of at most size queries of one length."""

    def run(batches):
        for ids, x in shards(batches, size):
            for i in range(0, len(ids), size):
                arrays = ids[i : i + size], x[i : i + size, :-1], x[i : i + size, -1]
                yield pa.RecordBatch.from_arrays([pa.array([x.shape[1] - 1], pa.int32()), *(pa.array([np.ascontiguousarray(z).tobytes()], pa.binary()) for z in arrays)], ["dim", "qids", "q", "kth"])

    return run


def search(k: int, probe: bool):
    """For mapInArrow: trees with blocks to the tree's best rows for each query."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_buffer() for name in (*TREE, "qids", "q", "kth")}
                dim = batch.column("dim")[i].as_py()
                best = Best(np.frombuffer(row["qids"], dtype=np.int64), np.frombuffer(row["q"]).reshape(-1, dim), np.frombuffer(row["kth"]), k)
                tree = BallTree.of_row(row, dim)
                tree.check(best.norms)
                (best.probe if probe else best.search)(tree)
                yield best.rows()

    return run


def usable(v: Column) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, fine)


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query with their ranks; partitions keep their own k best before they are sent."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0, block: int = BLOCK, groups: int = GROUPS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that is_query, the k best other rows.

    Components count as floor(scale * x). Queries are numbered as they are staged. One candidate more
    than k is kept until the end, when the query's own row is taken out: the first of its id with the
    score of the query with itself.
    """
    spark = vectors.sparkSession
    ship(spark)
    d = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), is_query.alias("is_query"))
    d = d.where(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("v", F.transform("v", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double")))
    trees = stage(d.select("id", "v").mapInArrow(build_trees(groups), ", ".join(["g int, dim int", *(f"{c} binary" for c in TREE)])), "trees")
    queries = stage(d.where("is_query").select(F.monotonically_increasing_id().alias("uid"), "id", "v"), "queries")

    def answers(asked: DataFrame, probe: bool) -> DataFrame:
        blocks = asked.mapInArrow(build_blocks(block), "dim int, qids binary, q binary, kth binary")
        blocks = blocks.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        return best_of(trees.join(blocks.hint("merge"), ["g", "dim"]).mapInArrow(search(k + 1, probe), FOUND), k + 1)

    with_kth = lambda kth: F.concat("v", F.array(kth)).alias("v")
    none = F.lit(float("-inf"))
    kth = answers(queries.select(F.col("uid").alias("id"), with_kth(none)), True).where(F.col("rank") == k + 1).select(F.col("query_id").alias("uid"), F.col("score").cast("double").alias("kth"))
    asked = stage(queries.join(kth, "uid", "left").select(F.col("uid").alias("id"), with_kth(F.coalesce("kth", none))), "asked")
    own = queries.select(F.col("uid").alias("query_id"), F.col("id").alias("own_id"), F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x).cast("long").alias("own_score"))
    found = answers(asked, False).join(own, "query_id")
    is_own = (F.col("vec_id") == F.col("own_id")) & (F.col("score") == F.col("own_score"))
    out = F.coalesce(F.min(F.when(is_own, F.col("rank"))).over(Window.partitionBy("query_id")), F.lit(k + 2))
    found = found.withColumn("out", out).where(F.col("rank") != F.col("out")).withColumn("rank", F.when(F.col("rank") > F.col("out"), F.col("rank") - 1).otherwise(F.col("rank")))
    out = stage(found.where(F.col("rank") <= k).select(F.col("own_id").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "top-k")
    drop_staged(spark, trees, queries, asked)
    return out
