import random

import pytest

from tensorloom.llm import mixing as M

SCHEMA = "doc_id long, source string, text string"


def fill(sizes):
    """Targets by sharing the excess again and again, as the rule reads."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total >= 2 * sizes[s]]
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= set(over)
    return out


def documents(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS size", "1 AS target", "2 AS n", "3 AS base")


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 1, 10, 500, 10_000]) for s in rng.sample(["a", "b", "B", "é", "", "zz", "ab", None], rng.randint(1, 8))}
    d = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in M.targets(d).collect()}
    assert got == pytest.approx(fill(sizes))
    assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_copies(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, rng.choice(["big", "big", "big", "mid", "x", None]), rng.choice([None, "", " \t", "w " * rng.randint(1, 40)])) for i in range(600)]
    rows += [(700, "mid", "same row")] * 3 + [(None, "mid", "no id"), (None, None, None)]
    d = documents(spark, rows)
    got = M.plan(d).withColumnsRenamed({"__mix_key": "doc_id", "__mix_source": "source"}).collect()
    words = lambda t: len((t or "").split())
    assert sorted(map(str, ((r.doc_id, r["__mix_size"]) for r in got))) == sorted(map(str, ((i, words(t)) for i, _, t in rows)))
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    want = fill(sizes)
    for s in sizes:
        of = [r for r in got if r.source == s]
        assert {r["__mix_source_size"] for r in of} == {sizes[s]}
        assert of[0]["__mix_target"] == pytest.approx(want[s])
        rate = want[s] / sizes[s] if sizes[s] else 0
        n = sum(r["__mix_copies"] for r in of)
        assert abs(n - rate * len(of)) < 1 + 1e-9  # one boundary for each whole copy expected
        assert all(int(rate) <= r["__mix_copies"] <= 2 and r["__mix_copies"] <= int(rate) + 1 for r in of)
        assert abs(sum(r["__mix_copies"] * r["__mix_size"] for r in of) - want[s]) <= max(r["__mix_size"] for r in of) + 1e-9
    again = M.plan(d.repartition(5)).withColumnsRenamed({"__mix_key": "doc_id", "__mix_source": "source"}).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_repeats_rows_and_keeps_columns(spark):
    d = documents(spark, [(i, "a" if i % 4 else "b", "word " * (i + 1)) for i in range(40)])
    out = M.mix(d)
    assert out.columns == d.columns
    taken = {r.doc_id: r["__mix_copies"] for r in M.plan(d).withColumnsRenamed({"__mix_key": "doc_id", "__mix_source": "source"}).collect()}
    found = {}
    for r in out.collect():
        found[r.doc_id] = found.get(r.doc_id, 0) + 1
    assert found == {i: n for i, n in taken.items() if n}


def test_empty_and_wordless(spark):
    assert M.plan(documents(spark, [])).count() == 0
    got = M.plan(documents(spark, [(1, "a", None), (2, None, "")])).collect()
    assert [(r["__mix_size"], r["__mix_target"], r["__mix_copies"]) for r in got] == [(0, 0.0, 0)] * 2


def test_rows_of_one_id_differ_by_text(spark):
    """Which text is repeated doesn't depend on how rows are dealt; rows repeated in full share out their copies."""
    rows = [(7, "a", f"x{i} y") for i in range(9)] + [(8, "a", "z z")] * 5 + [(9, "b", "w " * 50)]
    d = documents(spark, rows)
    key = lambda df: sorted(map(str, df.collect()))
    got = M.mix(d)
    assert got.columns == d.columns and key(got) == key(M.mix(d.repartition(4)))
    n = sum(r["__mix_copies"] for r in M.plan(d).collect())
    assert got.count() == n and got.where("doc_id = 8").count() == sum(r["__mix_copies"] for r in M.plan(d).where("__mix_key = 8").collect())
