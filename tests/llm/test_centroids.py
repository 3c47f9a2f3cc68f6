import hashlib
import random

import numpy as np
import pytest

from tensorloom.llm import centroids as C

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=40, rounds=5, dim=64):
    """Plain numbers, every vector against every centroid."""
    fine = [(i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), x) for i, x in fine)[:k]
    c = [x for _, x in first]
    apart = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    nearest = lambda x: min((apart(x, y), j) for j, y in enumerate(c))
    for _ in range(rounds):
        to = [nearest(x)[1] for _, x in fine]
        for j in range(len(c)):
            own = [x for (_, x), t in zip(fine, to, strict=True) if t == j]
            if own:
                c[j] = [sum(s) // len(own) for s in zip(*own, strict=True)]
    out = [(i, *nearest(x)[::-1]) for i, x in fine]
    own = {}
    for _, j, away in out:
        own[j] = own.get(j, 0) + away
    total = sum(own.values())
    return sorted(((i, j, away, own[j], total, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, away in out), key=str)


def run(spark, rows, **options):
    d = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).selectExpr("*", "1 AS id", "2 AS v", "3 AS cluster", "4 AS distance").repartition(3)
    return sorted((tuple(r) for r in C.cluster(d, **options).collect()), key=str)


@pytest.mark.parametrize("n,dim,k,shard,leaf", [(300, 2, 7, 64, 4), (500, 3, 12, 16_384, 8), (200, 64, 40, 50, 16), (30, 64, 40, 16_384, 64)])
def test_against_plain_numbers(spark, n, dim, k, shard, leaf):
    rng = np.random.default_rng(n)
    middle = rng.standard_normal((6, dim))
    rows = [(i, np.round(middle[i % 6] + rng.standard_normal(dim) / 4, 2).tolist()) for i in range(n)]
    assert run(spark, rows, k=k, dim=dim, shard=shard, leaf=leaf) == brute(rows, k, 5, dim)


def test_ties_repeated_rows_and_rows_that_take_no_part(spark):
    rng = random.Random(3)
    rows = [(i % 50, [rng.choice([0.0, 0.5, 1.0]), rng.choice([0.0, -1.0])]) for i in range(200)]
    rows += [(7, [0.25, 0.25])] * 300 + [(None, [0.5, 0.125]), (None, [2.0, 2.0])]
    bad = [(900, None), (901, []), (902, [1.0]), (903, [1.0, None]), (904, [float("nan"), 1.0]), (905, [1.0, float("-inf")]), (906, [1.0, 2.0, 3.0])]
    got = run(spark, rows + bad, k=5, dim=2, leaf=8)
    assert got == brute(rows, 5, 5, 2) and len(got) == len(rows)
    far = rows + [(1000 + i, [20_000.0 * i, -9_000.0]) for i in range(4)]  # beyond what doubles hold exactly
    assert run(spark, far, k=6, dim=2, leaf=8) == brute(far, 6, 5, 2)


def test_empty_and_too_large(spark):
    assert run(spark, []) == [] and run(spark, [(1, [1.0])]) == []
    with pytest.raises(Exception, match="64 bits"):
        run(spark, [(1, [3e6, 0.0])], dim=2)


def test_trees():
    rng = np.random.default_rng(1)
    x = rng.integers(-50, 50, (700, 3))
    t = C.KdTree(np.arange(700), np.ones(700), x, leaf=16)
    u = C.KdTree.of_row(t.to_row(), 3)
    assert all((getattr(t, f) == getattr(u, f)).all() for f in C.KdTree.FIELDS)
    for a, b, low, high, sums in zip(t.start, t.end, t.low, t.high, t.sums, strict=True):
        part = t.x[a:b]
        assert (part.min(axis=0) == low).all() and (part.max(axis=0) == high).all() and (part.sum(axis=0) == sums).all()
    assert (x[t.ids] == t.x).all()


def test_nodes_are_assigned_whole_and_centroids_pruned():
    rng = np.random.default_rng(2)
    middle = np.array([[0, 0], [1000, 0], [0, 1000], [1000, 1000]])
    x = np.concatenate([m + rng.integers(-20, 20, (500, 2)) for m in middle])
    t = C.KdTree(np.arange(len(x)), np.ones(len(x)), x, leaf=16)
    met = list(C.walk(t, middle))
    assert len(met) == 4 and all(isinstance(to, int) for _, to in met)
    n, sums = C.totals(t, middle)
    assert n.tolist() == [500] * 4 and (sums == [x[i * 500 : i * 500 + 500].sum(axis=0) for i in range(4)]).all()


def test_equal_vectors_make_one_leaf_that_ties_resolve():
    x = np.tile([[3, 4]], (1000, 1))
    t = C.KdTree(np.arange(1000), np.ones(1000), x, leaf=16)
    assert len(t.start) == 1
    assert C.assigned(t, np.array([[9, 9], [3, 5], [3, 3]]))[0].tolist() == [1] * 1000
