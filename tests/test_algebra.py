"""Laws of the built-in algebras, their scalar gradients, and types."""

import itertools

import pytest
from pyspark.sql import functions as F

from tensorloom.functions.algebra import ALGEBRAS, MAX_MUL, MIN_PLUS, STANDARD, algebra, is_zero, plus_gradient, times_gradient
from tensorloom.functions.dtypes import DTYPES, dtype
from tensorloom.plans.order import explain
from tensorloom.plans.spec import parse
from tensorloom.sources.tensor import TensorRel


@pytest.mark.parametrize("name", list(ALGEBRAS))
def test_laws(spark, name):
    a, t = ALGEBRAS[name], dtype("f64")
    values = [0.0, 1.0, 2.5, 4.0]
    rows = spark.createDataFrame(list(itertools.product(values, repeat=3)), "x double, y double, z double")
    x, y, z = (F.col(c) for c in "xyz")
    plus = lambda p, q: {0: p + q, 1: F.greatest(p, q), -1: F.least(p, q)}[a.picks]
    times = lambda p, q: a.times(p, q, t)
    zero, one = t.lit(a.zero(t)), t.lit(a.one(t))
    laws = [
        times(times(x, y), z) == times(x, times(y, z)), times(x, one) == x, plus(x, zero) == x, plus(x, y) == plus(y, x),
        times(x, plus(y, z)) == plus(times(x, y), times(x, z)), is_zero(zero, a, t), times(x, y) == times(y, x),
    ]
    assert rows.where(~F.array_contains(F.array(*laws), False)).count() == len(values) ** 3
    sums = spark.createDataFrame([(v,) for v in values], "x double").agg(a.plus(x, t).alias("s")).collect()[0].s
    assert sums == {0: 7.5, 1: 4.0, -1: 0.0}[a.picks]


def test_scalar_gradients(spark):
    t = dtype("f64")
    rows = spark.createDataFrame([(2.0, 3.0, 10.0), (3.0, 3.0, 10.0), (5.0, 3.0, 10.0)], "x double, y double, g double")
    x, y, g = (F.col(c) for c in "xyg")
    read = lambda pair: [tuple(r) for r in rows.select(*[c.alias(n) for c, n in zip(pair, "ab", strict=True)]).collect()]
    assert read(times_gradient(STANDARD, x, y, g, t)) == [(30.0, 20.0), (30.0, 30.0), (30.0, 50.0)]
    assert read(times_gradient(MIN_PLUS, x, y, g, t)) == [(10.0, 10.0)] * 3
    assert read(times_gradient(MAX_MUL, x, y, g, t)) == [(30.0, 20.0), (30.0, 30.0), (30.0, 50.0)]
    assert read(plus_gradient(STANDARD, x, y, g, t)) == [(10.0, 10.0)] * 3
    assert read(plus_gradient(MAX_MUL, x, y, g, t)) == [(0.0, 10.0), (10.0, 0.0), (10.0, 0.0)]
    assert read(plus_gradient(MIN_PLUS, x, y, g, t)) == [(10.0, 0.0), (10.0, 0.0), (0.0, 10.0)]


def test_types():
    assert set(DTYPES) == {"f32", "f64", "i32", "i64", "u32", "u64", "c32", "c64"}
    for f in (lambda: dtype("f16"), lambda: algebra("plusplus")):
        with pytest.raises(ValueError):
            f()
    assert algebra(STANDARD) is STANDARD


def test_complex_zero(spark):
    t = TensorRel.from_data(spark, [0, 1j], [2], "c64")
    assert [r.z for r in t.df.orderBy("d0").select(is_zero(F.col("v"), STANDARD, t.dtype).alias("z")).collect()] == [True, False]


def test_explain():
    spec = parse("(ij,jk),kl->il").with_sizes({c: 4 for c in "ijkl"})
    text = explain(spec)
    assert "#0 [i j] x #1 [j k] -> #3 [i k]  products 2^6.00, cells 2^4.00" in text and "tc 7.00" in text
    assert "no order yet" in explain(parse("ij,jk->ik").with_sizes({c: 2 for c in "ijk"}))
