"""Centroid clustering (Lloyd's rounds) over integer vectors with kd-trees that filter the centroids.

Each task builds kd-trees of its vectors once, at most SHARD vectors to a tree, and writes them to the
shared folder, a row for each tree. A node holds its box, its count and the integer sums of its
vectors. In a round every tree is walked level by level with the centroids that are left for each node:
of those, the one nearest the middle of the box is compared with each other one at the corner of
the box that lies farthest in the other's direction; an other that is farther even there can't win any
vector of the box and goes (strictly, so that ties stay). A node with one centroid left is
assigned as a whole, by its count and sums; leaves are resolved vector by vector. Trees give counts
and sums for each centroid, Spark adds them up, and k rows of new centroids reach the driver.

All numbers are whole. Distances are computed in doubles where all sums stay below 2^53, in 64-bit
integers beyond.

Defined results: vectors that are null, of another number of components than `dim` or hold null or
non-finite components take no part; ties of distance go to the smaller centroid number; repeated
rows and ids are vectors of their own; a null id is hashed as empty text, and of starting vectors
with one hash the least vector comes first; with fewer vectors than k all of them are centroids; empty
tables give empty results. Components whose distances may not fit 64 bits (of 64
components: 94,906,265 and more in size) are an error.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, ship, stage

#: Vectors of a tree, and of a leaf at most (more if they are all equal).
SHARD = 16_384
LEAF = 64


def below(bits: int, dim: int) -> int:
    """Components of less than that in size keep sums of squared distances below 2^bits."""
    return math.isqrt((1 << bits) // (8 * dim))


class KdTree:
    """Nodes in arrays, parents first: vectors [start, end) in the tree's order, children (-1: leaf), box, sums."""

    FIELDS = {"ids": np.int64, "known": np.uint8, "x": np.int32, "start": np.int32, "end": np.int32, "left": np.int32, "right": np.int32, "low": np.int32, "high": np.int32, "sums": np.int64}

    def __init__(self, ids: np.ndarray, known: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        """x: whole numbers, a row for each vector. Boxes are halved at the median of their widest side."""
        order = np.arange(len(x))
        start, end, left, right, low, high, sums = [0], [len(x)], [], [], [], [], []
        i = 0
        while i < len(start):
            a, b = start[i], end[i]
            part = x[order[a:b]]
            low.append(part.min(axis=0))
            high.append(part.max(axis=0))
            sums.append(part.sum(axis=0, dtype=np.int64))
            side = int(np.argmax(high[-1].astype(np.int64) - low[-1]))
            if b - a <= leaf or high[-1][side] == low[-1][side]:
                left.append(-1)
                right.append(-1)
            else:
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, side], half)]
                left.append(len(start))
                right.append(len(start) + 1)
                start += [a, a + half]
                end += [a + half, b]
            i += 1
        of = lambda name, v: np.asarray(v).astype(self.FIELDS[name])
        self.ids, self.known, self.x = of("ids", ids[order]), of("known", known[order]), of("x", x[order])
        self.start, self.end, self.left, self.right = of("start", start), of("end", end), of("left", left), of("right", right)
        self.low, self.high, self.sums = of("low", low), of("high", high), of("sums", sums)

    def to_row(self) -> dict[str, bytes]:
        return {name: np.ascontiguousarray(getattr(self, name)).tobytes() for name in self.FIELDS}

    @classmethod
    def of_row(cls, row: dict, dim: int) -> KdTree:
        tree = cls.__new__(cls)
        for name, kind in cls.FIELDS.items():
            v = np.frombuffer(row[name], dtype=kind)
            setattr(tree, name, v.reshape(-1, dim) if name in ("x", "low", "high", "sums") else v)
        return tree


def number(x: np.ndarray, exact: bool) -> np.ndarray:
    """In the type in which distances are computed."""
    return x.astype(np.float64 if exact else np.int64)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of c."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]


def survivors(tree: KdTree, nodes: np.ndarray, alive: np.ndarray, c: np.ndarray) -> np.ndarray:
    """alive (nodes by centroids) without the centroids that are dominated in the node's box."""
    low, high = tree.low[nodes].astype(c.dtype), tree.high[nodes].astype(c.dtype)
    middle = low + high  # twice the middle, so that it is a whole number
    norms = (c * c).sum(axis=1)
    # |middle / 2 - c|^2 without |middle / 2|^2; any centroid left would do as the best
    away = norms[None, :].astype(np.float64) - middle.astype(np.float64) @ c.T.astype(np.float64)
    best = np.argmin(np.where(alive, away, np.inf), axis=1)
    for k in range(len(c)):
        some = np.flatnonzero(alive[:, k] & (best != k))
        if len(some):
            step = c[k] - c[best[some]]
            corner = np.where(step > 0, high[some], low[some])
            # how much farther c[k] is than the best, at the corner that favours it most
            farther = norms[k] - norms[best[some]] - 2 * (corner * step).sum(axis=1)
            alive[some[farther > 0], k] = False
    return alive


def walk(tree: KdTree, c: np.ndarray):
    """(start, end, clusters): stretches of the tree's vectors with one cluster for all or one for each."""
    exact = max(np.abs(tree.low[0]).max(), np.abs(tree.high[0]).max(), np.abs(c).max()) < below(53, c.shape[1])
    c = number(c, exact)
    nodes, alive = np.zeros(1, dtype=np.int64), np.ones((1, len(c)), dtype=bool)
    while len(nodes):
        alive = survivors(tree, nodes, alive, c)
        one = alive.sum(axis=1) == 1
        for i in np.flatnonzero(one):
            yield int(nodes[i]), int(np.argmax(alive[i]))
        leaf = tree.left[nodes] < 0
        for i in np.flatnonzero(~one & leaf):
            some = np.flatnonzero(alive[i])
            node = int(nodes[i])
            x = number(tree.x[tree.start[node] : tree.end[node]], exact)
            yield node, some[np.argmin(distances(x, c[some]), axis=1)]
        on = ~one & ~leaf
        nodes, alive = np.concatenate([tree.left[nodes[on]], tree.right[nodes[on]]]), np.concatenate([alive[on], alive[on]])


def totals(tree: KdTree, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and sums of vectors for each centroid."""
    n, sums = np.zeros(len(c), dtype=np.int64), np.zeros(c.shape, dtype=np.int64)
    for node, to in walk(tree, c):
        a, b = tree.start[node], tree.end[node]
        if isinstance(to, int):
            n[to] += b - a
            sums[to] += tree.sums[node]
        else:
            n += np.bincount(to, minlength=len(c))
            np.add.at(sums, to, tree.x[a:b].astype(np.int64))
    return n, sums


def assigned(tree: KdTree, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of each vector of the tree."""
    clusters = np.empty(len(tree.x), dtype=np.int64)
    for node, to in walk(tree, c):
        clusters[tree.start[node] : tree.end[node]] = to
    away = tree.x.astype(np.int64) - c[clusters]
    return clusters, (away * away).sum(axis=1)


def build_trees(dim: int, shard: int, leaf: int):
    """For mapInArrow: (id, v) to trees of the task's vectors."""

    def tree(ids, known, x):
        row = KdTree(np.concatenate(ids), np.concatenate(known), np.concatenate(x), leaf).to_row()
        return pa.RecordBatch.from_arrays([pa.array([row[k]], pa.binary()) for k in KdTree.FIELDS], list(KdTree.FIELDS))

    def run(batches):
        ids, known, x, size = [], [], [], 0
        for batch in batches:
            id_ = batch.column("id")
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            if np.abs(v).max(initial=0) >= below(62, dim):
                raise ValueError(f"a component of {below(62, dim)} or more in size: distances may not fit 64 bits")
            for i in range(0, batch.num_rows, shard):
                part = id_.slice(i, shard)
                ids.append(part.fill_null(0).to_numpy(zero_copy_only=False))
                known.append(part.is_valid().to_numpy(zero_copy_only=False))
                x.append(v[i : i + shard])
                size += len(part)
                if size >= shard:
                    yield tree(ids, known, x)
                    ids, known, x, size = [], [], [], 0
        if size:
            yield tree(ids, known, x)

    return run


def trees_of(batches, dim: int):
    for batch in batches:
        for i in range(batch.num_rows):
            yield KdTree.of_row({k: batch.column(k)[i].as_buffer() for k in KdTree.FIELDS}, dim)


def usable(v: Column, dim: int) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return v.isNotNull() & (F.size(v) == dim) & F.forall(v, fine)


def one_round(trees: DataFrame, c: np.ndarray) -> np.ndarray:
    """The centroids after one assignment; an empty one stays. At most k rows come to the driver."""
    k, dim = c.shape

    def run(batches):
        n, sums = np.zeros(k, dtype=np.int64), np.zeros((k, dim), dtype=np.int64)
        for tree in trees_of(batches, dim):
            a, b = totals(tree, c)
            n, sums = n + a, sums + b
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(n[some], pa.int64()), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "s"])

    parts = trees.mapInArrow(run, "cluster long, n long, s array<long>")
    wide = [F.sum(F.get("s", F.lit(i)).cast("decimal(38,0)")) for i in range(dim)]
    new = c.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*wide).alias("s")).collect():
        new[r["cluster"]] = [int(s) // r["n"] for s in r["s"]]
    return new


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0, seed: str = "2", shard: int = SHARD, leaf: int = LEAF) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each vector that takes part.

    Components count as floor(scale * x). The k vectors whose sha256 of "seed:key" is smallest are the
    first centroids, in that order; each round assigns all vectors and takes the floor of the means.
    """
    spark = vectors.sparkSession
    ship(spark)
    d = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where(usable(F.col("v"), dim))
    d = d.withColumn("v", F.transform("v", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))
    digest = F.sha2(F.encode(F.concat(F.lit(seed + ":"), F.coalesce(F.col("id").cast("string"), F.lit(""))), "utf-8"), 256)
    first = d.select(digest.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    trees = stage(d.mapInArrow(build_trees(dim, shard, leaf), ", ".join(f"{c} binary" for c in KdTree.FIELDS)), "kd-trees")
    c = np.array([r["v"] for r in first], dtype=np.int64).reshape(-1, dim)
    for _ in range(rounds if len(c) else 0):
        c = one_round(trees, c)

    def run(batches):
        for tree in trees_of(batches, dim):
            to, away = assigned(tree, c)
            yield pa.RecordBatch.from_arrays([pa.array(tree.ids, pa.int64(), mask=tree.known == 0), pa.array(to, pa.int32()), pa.array(away, pa.int64())], ["id", "cluster", "distance"])

    out = stage(trees.mapInArrow(run, "id long, cluster int, distance long"), "clusters")
    # at most k rows
    inertia = {r["cluster"]: r["n"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    of = [(i, inertia.get(i), sum(inertia.values()), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for i, x in enumerate(c.tolist())]
    found = spark.createDataFrame(of, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    drop_staged(spark, trees)
    return out.join(F.broadcast(found), "cluster").select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
