import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.llm import topk as T

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=5, step=50):
    fine = [(i, np.floor(256 * np.array(v, dtype=np.float32).astype(np.float64)).astype(np.int64)) for i, v in rows if v and i is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (q, x) in enumerate(fine):
        if q % step == 0:
            found = sorted(((-int(x @ y), i) for n, (i, y) in enumerate(fine) if n != at and len(x) == len(y)))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def run(spark, rows, **options):
    d = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).selectExpr("*", "1 AS id", "2 AS v", "3 AS score").repartition(3)
    return sorted(tuple(r) for r in T.top_k(d, F.col("vec_id") % 50 == 0, **options).collect())


@pytest.mark.parametrize("n,dim,block,leaf", [(400, 8, 4096, 16), (400, 3, 2, 4), (3, 2, 4096, 128), (130, 16, 1, 32)])
def test_against_brute_force(spark, n, dim, block, leaf, monkeypatch):
    monkeypatch.setattr(T.BallTree.__init__, "__defaults__", (leaf,))
    rng = np.random.default_rng(n + dim)
    rows = [(i, np.round(rng.standard_normal(dim) / 2, 2).tolist()) for i in range(n)]
    assert run(spark, rows, block=block) == brute(rows)


def test_ties_and_rows_that_take_no_part(spark):
    rows = [(i, [1.0, 2.0]) for i in range(30)] + [(50, [1.0, 0.5]), (100, None), (150, [1.0, None]), (200, [float("nan"), 1.0]), (250, [float("inf"), 1.0]), (300, []), (350, [1.0]), (400, [2.0, 2.0, 2.0]), (401, [1.0, 1.0, 1.0]), (None, [9.0, 9.0])]
    got = run(spark, rows)
    assert got == brute(rows)
    assert [x for x in got if x[0] == 350] == [] and [x for x in got if x[0] == 400] == [(400, 1, 401, 512 * 256 * 3)]


def test_rows_that_share_an_id(spark):
    """Each asks and answers for itself; only the row itself is left out."""
    rows = [(0, [1.0, 0.0]), (0, [5.0, 0.0]), (1, [0.5, 0.0])]
    got = run(spark, rows)
    assert got == brute(rows) and [x for x in got if x[2] == 0 and x[1] == 1] == [(0, 1, 0, 5 << 16)] * 2
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(a), float(b)]) for i, a, b in zip(rng.integers(0, 4, 200) * 25, rng.integers(-2, 3, 200), rng.integers(-2, 3, 200), strict=True)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows[:4] * 3) == brute(rows[:4] * 3)


def test_scores_that_doubles_cannot_hold(spark):
    with pytest.raises(Exception, match="2\\^53"):
        run(spark, [(0, [1e8, 1.0]), (1, [1e8, 2.0])])


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(1, [1.0])]) == []


def test_bounds_hold():
    rng = np.random.default_rng(0)
    x = np.floor(rng.standard_normal((500, 6)) * 100)
    tree = T.BallTree(np.arange(500), x, leaf=16)
    q = np.floor(rng.standard_normal((20, 6)) * 100)
    up = tree.bounds(tree.levels, q, np.sqrt((q**2).sum(axis=1)))
    for leaf, rows in enumerate(tree.leaves):
        assert ((q @ x[rows].T).max(axis=1) <= up[:, leaf]).all()


def test_trees_as_rows():
    rng = np.random.default_rng(3)
    for n in (1, 5, 128, 129, 700):
        x = np.floor(rng.standard_normal((n, 4)) * 50)
        a = T.BallTree(rng.permutation(n), x, leaf=32)
        b = T.BallTree.of_row(a.to_row(), 4)
        assert a.levels == b.levels and [a.ids[p].tolist() for p in a.leaves] == [b.ids[p].tolist() for p in b.leaves]
        assert all((p == q).all() for p, q in zip([*a.centre, *a.radius], [*b.centre, *b.radius], strict=True))
        assert all((a.x[p] == b.x[q]).all() for p, q in zip(a.leaves, b.leaves, strict=True))


def test_vectors_are_read_twice_however_many_blocks(spark, monkeypatch):
    """Once for the trees, once for the queries; blocks meet trees by a join."""
    built = []
    monkeypatch.setattr(T, "build_trees", lambda g, of=T.build_trees: (built.append(g), of(g))[1])
    rows = [(i, [float(i % 7), float(i % 5)]) for i in range(300)]
    assert run(spark, rows, block=1, groups=3) == brute(rows) and built == [3]


def test_nodes_below_the_kth_score_are_not_visited():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.standard_normal((200, 4)) + 40 * c for c in np.eye(4)])
    tree = T.BallTree(np.arange(len(x)), np.floor(x * 10), leaf=16)
    best = T.Best(np.array([-1]), np.array([[400.0, 0, 0, 0]]), np.array([-np.inf]), 5)
    seen = []
    look = best.look
    best.look = lambda tree, leaf, rows: (seen.append(leaf), look(tree, leaf, rows))
    best.search(tree)
    assert len(seen) < len(tree.leaves) / 2
