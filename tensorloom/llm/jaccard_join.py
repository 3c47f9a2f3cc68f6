"""Similarity join of documents by the Jaccard similarity of their word shingles.

Equal sets are one entity. Shingles found in many documents are frequent; in the global order rare
ones come first, each class by hash. A set of n shingles may miss e = n - ceil(0.8 n) of them in a
similar set. Its prefix is extended until its signatures outnumber e: each rare shingle is a
signature by itself, frequent ones are dealt to groups and every two of a group are one, where a
group of c counts c - 1. Two similar sets then share a signature: were all rare shingles of the
shorter prefix missing in the other set and all but one of each group, more than e would be. The
number of groups goes with the power of two below n, and a set whose similar sets may lie in the
next class makes signatures for that class too.

A signature's hub is the member with the largest share of frequent shingles, which near copies of
one text have in common. Each set is first paired with the best of its hubs; then, in signatures
whose members aren't in one component yet, with the hubs of other components. A pair is dropped
if the histograms of its sets by hash leave no room for a large enough intersection; the others
are verified by exact intersection. Signatures whose members are in several components still are compared exactly: in those of up to
GROUP members the pairs that cross components are verified in the same way, once for all signatures with the same members; members of larger
ones, and of those of frequent shingles, are joined to clusters, a cluster is dealt by size to
blocks of bounded bytes, and each two blocks whose sizes allow links are compared in a task of their
own, which returns a forest of their links. So all links either are verified or lie inside a component.

Equal sets are counted and signed once, by one of their rows, as far as the list of sets that several rows have
goes (COPIED); that keeps the signatures from growing with the copies.

Frequent shingles are found by counting, over all documents, the first 2 (e + 1) shingles of each
by hash, which leaves room for the shingles that move back, and those that occur three times among
about a million neighbouring shingles. Documents of which so many moved back that the prefix
goes beyond the counted shingles have their other shingles counted in a second pass. Those with 8 or more are frequent (4
in the second pass); where these are more than 2^21, the smallest number is taken that leaves at most 2^21 of each pass. It is at
most count of all / 2^21. The choice affects the work, never the result.
64-bit hashes stand for shingles and sets.

Defined results: null text and text without words have an empty set, link with nothing and are a
component of their own; fewer than five words make one shingle; repeated rows are copies; a
component's id is its smallest id, null ids not counting; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .common import drop_staged, ship, stage
from .hashing import mixed
from .shingles import WORDS, identity, text_sets

PERCENT = 80
#: A shingle is frequent from this many documents; at most 2^PART are, those with the highest counts.
FREQUENT = 8
PART = 21
GATHERED = 1_000_000
#: Up to so many ids at once are sent to all tasks to pick out texts, in at most SCANS passes over the
#: documents; more are joined by a shuffle of all texts.
SENT_IDS = 1_000_000
SCANS = 8
#: Sets that several rows have, those with the most rows first: up to so many are counted and signed for one row only.
COPIED = 1 << 19
#: Members of a signature that are paired one by one; sets and shingles in a block.
GROUP = 64
BLOCK = 1024
HELD = 1 << 19
#: Shingles in a chunk of a block's incidence matrix.
COLUMNS = 4096


def needed(n: int, percent: int = PERCENT) -> int:
    """Shingles that a similar set shares at least."""
    return -(-percent * n // 100)


def describe(size: int):
    """For mapInArrow: (id, rid, text) to (id, rid, ent, n, hist)."""

    def run(batches):
        for part, found in text_sets(batches, size):
            columns = [part.column("id"), part.column("rid"), pa.array([identity(s) for s in found], pa.int64()), pa.array([len(s) for s in found], pa.int64()), pa.array([histogram(s).tobytes() for s in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "rid", "ent", "n", "hist"])

    return run


class Once:
    """Which rows stand for their sets: (ent, rid) sorted by ent are the sets of several rows, with the row that does."""

    def __init__(self, ent: np.ndarray, rid: np.ndarray):
        self.ent, self.rid = ent, rid

    def sets(self, part, found: list[np.ndarray]) -> list[np.ndarray]:
        """The sets of a slice that aren't empty, without those for which another row stands."""
        own = [(s, rid) for s, rid in zip(found, part.column("rid").to_numpy(zero_copy_only=False), strict=True) if len(s)]
        if not own or not len(self.ent):
            return [s for s, _ in own]
        ent = np.array([identity(s) for s, _ in own], dtype=np.int64)
        at = np.minimum(np.searchsorted(self.ent, ent), len(self.ent) - 1)
        other = (self.ent[at] == ent) & (self.rid[at] != np.array([rid for _, rid in own], dtype=np.int64))
        return [s for (s, _), o in zip(own, other, strict=True) if not o]


def count_first(size: int, percent: int, once):
    """For mapInArrow: (rid, text) to partial counts (s, n) of the shingles that come first by hash or are frequent nearby."""

    def counts(held):
        first = np.concatenate([s[: 2 * (len(s) - needed(len(s), percent) + 1)] for s in held])
        s, n = np.unique(np.concatenate(held), return_counts=True)
        wanted = n >= 3
        wanted[np.searchsorted(s, first)] = True
        s, n = s[wanted], n[wanted]
        return pa.RecordBatch.from_arrays([pa.array(s.view(np.int64), pa.int64()), pa.array(n, pa.int64())], ["s", "n"])

    def run(batches):
        held, gathered = [], 0
        for part, found in text_sets(batches, size):
            found = once.value.sets(part, found)
            held += found
            gathered += sum(map(len, found))
            if gathered > GATHERED:
                yield counts(held)
                held, gathered = [], 0
        if held:
            yield counts(held)

    return run


def is_known(s: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each shingle is among known, which is sorted."""
    if not len(known):
        return np.zeros(len(s), dtype=bool)
    return known[np.minimum(np.searchsorted(known, s), len(known) - 1)] == s


def count_rest(size: int, percent: int, once, frequent):
    """For mapInArrow: (rid, text) to partial counts (s, n) of shingles that the first count left out and a prefix may reach."""

    def counts(held):
        s, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(s.view(np.int64), pa.int64()), pa.array(n, pa.int64())], ["s", "n"])

    def run(batches):
        known = np.sort(frequent.value.view(np.uint64))
        held, gathered = [], 0
        for part, found in text_sets(batches, size):
            for s in once.value.sets(part, found):
                prefix_size = len(s) - needed(len(s), percent) + 1
                rare = ~is_known(s, known)
                if rare[: 2 * prefix_size].sum() < prefix_size:
                    held.append(s[2 * prefix_size :][rare[2 * prefix_size :]])
                    gathered += len(held[-1])
            if gathered > GATHERED:
                yield counts(held)
                held, gathered = [], 0
        if held:
            yield counts(held)

    return run


def histogram(s: np.ndarray) -> np.ndarray:
    """Counts of a set's shingles by their low bits, about 8 to 16 to a place in long sets; 65535 stands for any more."""
    places = 1 << max(8, len(s).bit_length() - 4)
    return np.minimum(np.bincount((s & np.uint64(places - 1)).astype(np.int64), minlength=places), 65535).astype(np.uint16)


def may_be_similar(percent: int):
    """For mapInArrow: (a, b, na, nb, x, y) to the pairs (a, b) whose histograms allow the similarity."""

    def run(batches):
        for batch in batches:
            keep = []
            for na, nb, x, y in zip(*(batch.column(c) for c in ("na", "nb", "x", "y")), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), dtype=np.uint16).astype(np.int64) for z in (x, y))
                if len(x) != len(y):
                    x, y = (z if len(z) == min(len(x), len(y)) else z.reshape(-1, min(len(x), len(y))).sum(axis=0) for z in (x, y))
                least = np.minimum(x, y)
                both, n = int(least.sum()), na.as_py() + nb.as_py()
                keep.append(bool(least.max(initial=0) >= 65535) or 100 * both >= percent * (n - both))
            keep = np.flatnonzero(keep)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep)) for c in ("a", "b")], ["a", "b"])

    return run


def prefix(frequent: np.ndarray, need: int, groups: int):
    """How many frequent shingles are needed, and the group of each."""
    g = ((frequent >> np.uint64(32)) % np.uint64(groups)).astype(np.int64)
    _, first = np.unique(g, return_index=True)
    worth = np.ones(len(g), dtype=np.int64)
    worth[first] = 0
    return int(np.searchsorted(np.cumsum(worth), need)) + 1, g


def signatures(s: np.ndarray, is_frequent: np.ndarray, percent: int = PERCENT):
    """(signatures of one rare shingle, signatures of two frequent ones) of a set."""
    none = np.empty(0, dtype=np.uint64)
    n = len(s)
    missing = n - needed(n, percent)
    if n * 100 // percent == n:
        return none, none  # a larger set isn't similar, nor a smaller one: only an equal one is
    rare, frequent = s[~is_frequent], s[is_frequent]
    if len(rare) > missing:
        return rare[: missing + 1], none
    pairs = []
    own = n.bit_length() - 1
    for cls in range(own, (n * 100 // percent).bit_length()):
        k, g = prefix(frequent, missing + 1 - len(rare), 1 << max(0, cls - 5))
        t, g = frequent[:k], g[:k]
        order = np.argsort(g, kind="stable")
        t, g = t[order], g[order]
        step = 1
        while True:
            same = np.flatnonzero(g[step:] == g[:-step]) if step < len(g) else []
            if not len(same):
                break
            pairs.append(mixed(t[same] * np.uint64(0x9E3779B97F4A7C15) + t[same + step] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(cls)))
            step += 1
    return rare, np.concatenate(pairs) if pairs else none


def sign(size: int, percent: int, once, frequent):
    """For mapInArrow: (rid, text) to (sig, ent, n, order, pair); the member of least order is a signature's hub."""

    def run(batches):
        known = np.sort(frequent.value.view(np.uint64))
        for part, found in text_sets(batches, size):
            sig, ent, n, rank, pair = [], [], [], [], []
            for s in once.value.sets(part, found):
                is_frequent = is_known(s, known)
                one, two = signatures(s, is_frequent, percent)
                both = np.concatenate([one, two])
                sig.append(both)
                ent.append(np.full(len(both), identity(s), dtype=np.int64))
                n.append(np.full(len(both), len(s), dtype=np.int32))
                rank.append(np.full(len(both), 1000 - 1000 * int(is_frequent.sum()) // len(s), dtype=np.int32))
                pair.append(np.arange(len(both)) >= len(one))
            if sig:
                columns = [np.concatenate(sig).view(np.int64), *(np.concatenate(x) for x in (ent, n, rank, pair))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["sig", "ent", "n", "order", "pair"])

    return run


def members():
    """For mapInArrow over rows sorted by sig, order, ent: rows of signatures with two entities or more, with the first one as hub."""

    def groups(sig, ent, n, order):
        new = np.ones(len(sig), dtype=bool)
        new[1:] = (sig[1:] != sig[:-1]) | (ent[1:] != ent[:-1])
        sig, ent, n, order = sig[new], ent[new], n[new], order[new]
        i = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.empty(0, dtype=np.int64)
        size = np.diff(np.concatenate([i, [len(sig)]]))
        many = np.repeat(size > 1, size)
        hub, best = np.repeat(ent[i], size), np.repeat(order[i], size)
        return pa.RecordBatch.from_arrays([pa.array(x[many]) for x in (sig, ent, n, best, hub)], ["sig", "ent", "n", "best", "hub"])

    def run(batches):
        rest = [np.empty(0, dtype=t) for t in (np.int64, np.int64, np.int32, np.int32)]
        for batch in batches:
            if not batch.num_rows:
                continue
            rest = [np.concatenate([r, batch.column(c).to_numpy(zero_copy_only=False)]) for r, c in zip(rest, ("sig", "ent", "n", "order"), strict=True)]
            end = int(np.searchsorted(rest[0], rest[0][-1]))  # the last signature may go on in the next batch
            yield groups(*(r[:end] for r in rest))
            rest = [r[end:] for r in rest]
        yield groups(*rest)

    return run


def make_sets(size: int):
    """For mapInArrow: (ent, text) to (ent, shingles) as bytes, for texts that have that set."""

    def run(batches):
        for part, found in text_sets(batches, size):
            own = [(e, s.tobytes()) for e, s in zip(part.column("ent").to_pylist(), found, strict=True) if identity(s) == e]
            yield pa.RecordBatch.from_arrays([pa.array([e for e, _ in own], pa.int64()), pa.array([b for _, b in own], pa.binary())], ["ent", "shingles"])

    return run


def intersect(batches):
    """For mapInArrow: (a, b, x, y) to (a, b, both, na, nb)."""
    for batch in batches:
        out = []
        last = s = None
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            x = x.as_buffer()
            if last is None or not x.equals(last):
                last, s = x, np.frombuffer(x, dtype=np.uint64)
            t = np.frombuffer(y.as_buffer(), dtype=np.uint64)
            at = np.searchsorted(s, t)
            out.append((int((s[np.minimum(at, len(s) - 1)] == t).sum()), len(s), len(t)))
        both = [pa.array([o[k] for o in out], pa.int64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *both], ["a", "b", "both", "na", "nb"])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of some sets."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n > 1
    column_of = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], column_of[column[keep]]
    both = np.zeros((len(sets), len(sets)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        x = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        x[row[a:b], column[a:b] - at] = 1
        both += x @ x.T
    np.fill_diagonal(both, [len(s) for s in sets])
    return both.astype(np.int64)


def compare_blocks(percent: int):
    """For applyInArrow: the sets of two blocks to a forest of their links (u, v)."""

    def run(table):
        table = table.combine_chunks()
        ent = table.column("ent").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in table.column("shingles")]
        n = np.array([len(s) for s in sets])
        both = overlaps(sets)
        similar = 100 * both >= percent * (n[:, None] + n[None, :] - both)
        least = np.arange(len(sets))
        while True:  # labels spread along links until they stand still
            new = np.where(similar, least[None, :], len(sets)).min(axis=1)
            if (new == least).all():
                break
            least = new
        linked = np.flatnonzero(least != np.arange(len(sets)))
        return pa.table({"u": pa.array(ent[least[linked]], pa.int64()), "v": pa.array(ent[linked], pa.int64())})

    return run


def compare_clusters(members: DataFrame, docs: DataFrame, entities: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (u, v) among the sets of each cluster, for rows (ent, hub) that put them together.

    A cluster's sets are dealt to tiers by size, so wide that similar sets lie in one tier or in two
    neighbouring ones, and a tier's to blocks of at most about BLOCK sets and HELD shingles. Blocks
    meet those of their own tier and its neighbours.
    """
    clusters = components(members.select(F.col("hub").alias("u"), F.col("ent").alias("v"))).select(F.col("node").alias("ent"), F.col("root").alias("cluster"))
    width = math.log(100 / percent) + 1e-9  # more than the rounding of logarithms
    tier = F.floor(F.log("n") / width).cast("long")
    clusters = stage(clusters.join(entities.select("ent", "rid", "n"), "ent").withColumn("tier", tier), "clusters")
    blocks = clusters.groupBy("cluster", "tier").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / HELD)).cast("long").alias("blocks"))
    sets = stage(texts_of(docs, clusters.select("rid", "ent")).mapInArrow(make_sets(size), "ent long, shingles binary").dropDuplicates(["ent"]), "shingles")
    place = lambda block: F.shiftleft("tier", 32) + block
    d = clusters.join(blocks, ["cluster", "tier"]).select("ent", "cluster", "tier", place(F.pmod(F.xxhash64("ent"), F.col("blocks"))).alias("own"))
    d = d.join(sets, "ent").withColumn("tier", F.explode(F.array(F.col("tier") - 1, "tier", F.col("tier") + 1))).join(blocks, ["cluster", "tier"])
    d = d.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    other = place(F.col("block"))
    d = d.select("ent", "shingles", "cluster", F.least("own", other).alias("x"), F.greatest("own", other).alias("y"))
    out = stage(d.groupBy("cluster", "x", "y").applyInArrow(compare_blocks(percent), "u long, v long"), "links")
    drop_staged(docs.sparkSession, sets, clusters)
    return out


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(ent, text) for the rows (rid, ent) of wanted, rid standing for id and text; a bounded number of them at once is sent to all tasks."""
    n = wanted.count()
    if n > SCANS * SENT_IDS:
        return docs.join(wanted.hint("shuffle_hash"), "rid").select("ent", "text")
    scans = max(1, -(-n // max(1, SENT_IDS)))
    part = F.pmod("rid", F.lit(scans).cast("long"))
    found = [docs.join(F.broadcast(wanted.where(part == i)), "rid").select("ent", "text") for i in range(scans)]
    return reduce(DataFrame.unionAll, found)


def verify(pairs: DataFrame, docs: DataFrame, entities: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b, d, similar) of the pairs (a, b) that may be similar, d being the distance."""
    side = lambda c, n, h: entities.select(F.col("ent").alias(c), F.col("n").alias(n), F.col("hist").alias(h))
    near = (100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na"))
    p = pairs.join(side("b", "nb", "y"), "b").join(side("a", "na", "x"), "a").where(near).select("a", "b", "na", "nb", "x", "y")
    p = stage(p.mapInArrow(may_be_similar(percent), "a long, b long"), "pairs")

    wanted = p.select(F.col("a").alias("ent")).union(p.select(F.col("b").alias("ent"))).distinct().join(entities.select("ent", "rid"), "ent").select("rid", "ent")
    sets = stage(texts_of(docs, stage(wanted, "wanted")).mapInArrow(make_sets(size), "ent long, shingles binary").dropDuplicates(["ent"]), "shingles")
    a = sets.select(F.col("ent").alias("a"), F.col("shingles").alias("x"))
    b = sets.select(F.col("ent").alias("b"), F.col("shingles").alias("y"))
    p = p.join(b, "b").join(a, "a").select("a", "b", "x", "y")
    p = p.mapInArrow(intersect, "a long, b long, both long, na long, nb long")
    union = F.col("na") + F.col("nb") - F.col("both")
    out = stage(p.select("a", "b", (1 - F.col("both") / union).alias("d"), (100 * F.col("both") >= percent * union).alias("similar")), "verified")
    drop_staged(docs.sparkSession, sets)
    return out


def copied(rows: DataFrame):
    """Sent to all tasks: the sets that several rows have, at most COPIED, with one row each; others are signed by each of their rows."""
    many = rows.where("n > 0").groupBy("ent").agg(F.count("*").alias("k"), F.min("rid").alias("rid")).where("k > 1")
    found = many.orderBy(F.desc("k"), "ent").limit(COPIED).select("ent", "rid").toArrow().sort_by("ent")
    return rows.sparkSession.sparkContext.broadcast(Once(found.column("ent").to_numpy(), found.column("rid").to_numpy()))


def listed(counts: DataFrame, least: int, total: int) -> np.ndarray:
    """The shingles found in `least` documents or more, or in the smallest larger number that leaves at most 2^PART of them.

    From total / 2^PART on there are no more of them, whatever the counts, so only smaller numbers are looked at.
    """
    most = max(least, total >> PART)
    found = {r["n"]: r["k"] for r in counts.where(F.col("n") >= least).groupBy(F.least("n", F.lit(most)).alias("n")).agg(F.count("*").alias("k")).collect()}
    held, from_ = found.pop(most, 0), most
    for n in sorted(found, reverse=True):
        if held + found[n] > 1 << PART:
            break
        held, from_ = held + found[n], n
    return counts.where(F.col("n") >= from_).select("s").toArrow().column("s").to_numpy()


def row_id(key: str, text: str) -> Column:
    """A number for a row's id and text."""
    return F.xxhash64(F.col(key), F.col(text))


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id) for each row of docs."""
    return classes_by_row(docs, text, key, size, percent).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")


def classes_by_row(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, rid, n, class, component_id) for each row of docs; class is null for empty sets."""
    spark = docs.sparkSession
    ship(spark)
    d = docs.select(F.col(key).cast("long").alias("id"), row_id(key, text).alias("rid"), F.col(text).alias("text"))
    rows = stage(d.mapInArrow(describe(size), "id long, rid long, ent long, n long, hist binary"), "sets")
    once = copied(rows)
    texts = d.select("rid", "text")
    counts = stage(texts.mapInArrow(count_first(size, percent, once), "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT), "counts")
    total = rows.agg(F.coalesce(F.sum(2 * F.floor(F.col("n") * (100 - percent) / 100) + 2), F.lit(0))).collect()[0][0]
    frequent = listed(counts, FREQUENT, int(total))
    rest = texts.mapInArrow(count_rest(size, percent, once, spark.sparkContext.broadcast(frequent)), "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    rest = stage(rest.where(F.col("n") >= FREQUENT // 2), "rest")  # the first count may have seen the others
    frequent = np.concatenate([frequent, listed(rest, FREQUENT // 2, int(total))])

    signed = stage(texts.mapInArrow(sign(size, percent, once, spark.sparkContext.broadcast(frequent)), "sig long, ent long, n int, order int, pair boolean"), "signatures")
    ones = signed.where("NOT pair").select("sig", "order", "ent", "n").repartition("sig").sortWithinPartitions("sig", "order", "ent")
    ones = ones.mapInArrow(members(), "sig long, ent long, n int, best int, hub long").withColumn("pair", F.lit(False))
    two = signed.where("pair").groupBy("sig", "ent").agg(F.min("n").alias("n"), F.min("order").alias("order"))
    firsts = two.groupBy("sig").agg(F.min(F.struct("order", "ent")).alias("first"), F.count("*").alias("k")).where("k > 1")
    two = two.join(firsts, "sig").select("sig", "ent", "n", F.col("first.order").alias("best"), F.col("first.ent").alias("hub"), F.lit(True).alias("pair"))
    found = stage(ones.union(two), "members")
    drop_staged(spark, signed, counts, rest)

    # the entities that share a signature, with the smallest id that has each, and one row
    reps = rows.where("n > 0").groupBy("ent").agg(F.min("id").alias("rep"), F.min("rid").alias("rid"), F.first("n").alias("n"))
    hists = rows.select("ent", "hist").join(found.select("ent").distinct(), "ent", "left_semi").dropDuplicates(["ent"])
    entities = stage(reps.join(hists, "ent"), "entities")

    spokes = found.where("ent <> hub")
    star = spokes.groupBy("ent").agg(F.min(F.struct("best", "hub")).alias("to")).select(F.col("to.hub").alias("a"), F.col("ent").alias("b"))
    verified = verify(star, d, entities, size, percent)
    roots = components(links_of(verified))

    def labelled():
        """Members of signatures, with their components."""
        return found.join(roots, found["ent"] == roots["node"], "left").select("sig", "ent", "n", "hub", "pair", F.coalesce("root", "ent").alias("root"))

    hubs = roots.select(F.col("node").alias("hub"), F.col("root").alias("hub_root"))
    star = labelled().where("ent <> hub").select("ent", "hub", "root").distinct().join(hubs, "hub", "left")
    star = star.where(F.col("root") != F.coalesce("hub_root", "hub")).select(F.col("hub").alias("a"), F.col("ent").alias("b"))
    verified = verified.union(verify(star, d, entities, size, percent))
    roots = components(links_of(verified))

    # signatures whose members are in several components still
    rest = labelled()
    open_ = rest.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("k"), F.max("pair").alias("pair")).where("lo <> hi AND k > 2")
    rest = stage(rest.join(open_.select("sig", (F.col("pair") | (F.col("k") > GROUP)).alias("large")), "sig"), "open")
    few = stage(one_of_equal(rest.where("NOT large AND ent <> hub")), "few")
    x = few.select("sig", F.col("ent").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"))
    y = x.toDF("sig", "b", "nb", "rb")
    near = (100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na"))
    across = x.join(y, "sig").where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & near).select("a", "b").distinct()
    more = links_of(verify(across, d, entities, size, percent))
    large = rest.where("large AND ent <> hub").select("ent", "hub").distinct()
    more = more.union(compare_clusters(large, d, entities, size, percent))
    if more.take(1):
        roots = components(links_of(verified).union(more))

    named = reps.join(roots, reps["ent"] == roots["node"], "left").select("ent", "rep", F.coalesce("root", "ent").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = stage(named.join(least, "root").select("ent", F.col("root").alias("class"), "component_id"), "classes")
    drop_staged(spark, found, entities, rest, few)
    linked = rows.where("n > 0").join(named, "ent").select("id", "rid", "n", "class", "component_id")
    alone = rows.where("n = 0").select("id", "rid", "n", F.lit(None).cast("long").alias("class"), F.col("id").alias("component_id"))
    return linked.union(alone)


def one_of_equal(members: DataFrame) -> DataFrame:
    """The rows (sig, ent, ...) of one signature for each set of members: a passage that some texts share makes many with the same ones."""
    each = members.groupBy("sig").agg(F.sort_array(F.collect_list("ent")).alias("ents"))
    return members.join(each.groupBy("ents").agg(F.min("sig").alias("sig")).select("sig"), "sig", "left_semi")


def links_of(verified: DataFrame) -> DataFrame:
    return verified.where("similar").select(F.col("a").alias("u"), F.col("b").alias("v"))


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each class, with the columns of docs: that with the smallest id, null ids last.

    Of rows of a class with one id one stays, by a digest of the text; rows without words stay all.
    """
    rows = classes_by_row(docs, text, key)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "rid")
    chosen = rows.where(F.col("class").isNotNull()).groupBy("class").agg(F.min(order).alias("row")).select(F.col("row.rid").alias("__jj_rid"))
    copies = rows.groupBy("rid").agg(F.count("*").alias("copies"), F.max("n").alias("n"))
    chosen = chosen.join(copies, F.col("__jj_rid") == F.col("rid")).select("__jj_rid", (F.col("copies") > 1).alias("__jj_many"))
    empty = copies.where("n = 0").select(F.col("rid").alias("__jj_rid"), F.lit(False).alias("__jj_many"))
    chosen = stage(chosen.union(empty), "chosen")
    kept = lambda some: docs.withColumn("__jj_rid", row_id(key, text)).join(some.hint("shuffle_hash"), "__jj_rid", "left_semi")
    out = kept(chosen.where("NOT __jj_many"))
    many = chosen.where("__jj_many")
    if many.take(1):  # rows repeated in id and text
        out = out.unionByName(kept(many).dropDuplicates(["__jj_rid"]))
    return out.select(*docs.columns)
