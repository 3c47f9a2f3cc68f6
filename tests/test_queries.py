"""Queries against the SQL that states their results, at the smallest size."""

import os

import duckdb
import pytest

from tensorloom import queries as Q

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return con


@pytest.mark.parametrize("name", list(Q.queries()))
def test_query(spark, tables, name):
    df = Q.queries()[name](spark, DIR)
    rows = df.collect()
    if name not in Q.oracle_sql():
        assert rows
        return
    found = tables.execute(Q.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda r: tuple(str(x) for x in r)
    want = sorted((tuple(r) for r in found.fetchall()), key=key)
    got = sorted((tuple(r[c] for c in names) for r in rows), key=key)
    assert got == [tuple(pytest.approx(x, abs=1e-6) if isinstance(x, float) else x for x in r) for r in want]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_eager_aggregation_and_broadcast_in_the_plan(spark):
    """Labels that one side alone has are added up below the join, and small operands are broadcast."""
    plan = Q.queries()["chain3"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert "Python" not in plan and "CartesianProduct" not in plan


def test_dense_gram_takes_all_rows_in_blocks(spark, monkeypatch):
    rows = lambda name: sorted(tuple(r[c] for c in ("d0", "d1", "v")) for r in Q.queries()[name](spark, DIR).collect())
    want = rows("gram_W")
    assert rows("gram_dense") == want
    monkeypatch.setattr(Q.dense, "CELLS", 4096)
    assert rows("gram_dense") == want
