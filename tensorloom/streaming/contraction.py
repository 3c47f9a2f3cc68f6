"""Contraction of a streamed operand with static ones (an extension).

Rows of the stream are added to the tensor as they come. Products with static operands distribute
over the sum, so the result's aggregate can be kept up to date: write it in update or complete
mode. Only algebras whose addition Spark aggregates incrementally apply, which all built-in ones do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import STANDARD, Algebra, algebra
from ..functions.dtypes import dtype
from ..operators.contract import Names
from ..plans.spec import EinsumSpec, parse
from ..sources.tensor import TensorRel


def contract_stream(stream: DataFrame, expression: str | EinsumSpec, static: Sequence[TensorRel], sizes, algebra_: str | Algebra = STANDARD, dtype_: str = "i64") -> DataFrame:
    """A streaming DataFrame (d0, ..., v) of the contraction.

    stream has the columns d0, d1, ... and v and is the first operand, whose labels must differ;
    several rows of one cell are added up. sizes are those of its labels.
    """
    a, t = algebra(algebra_), dtype(dtype_)
    spec = parse(expression, sizes) if isinstance(expression, str) else expression
    spec = spec.with_sizes(sizes)
    first = spec.ixs[0]
    if len(set(first)) != len(first):
        raise ValueError("labels of the streamed operand must differ")
    spec = spec.bind([tuple(spec.sizes[c] for c in first), *(x.shape for x in static)])
    names = Names(spec.sizes)
    df = stream.select(*[F.col(f"d{i}").alias(names[c]) for i, c in enumerate(first)], F.col("v").cast(t.spark).alias("v"))
    have = list(first)
    for ix, x in zip(spec.ixs[1:], static, strict=True):
        if len(set(ix)) != len(ix):
            raise ValueError("labels of a static operand must differ")
        right = x.df.select(*[F.col(f"d{i}").alias(names[c]) for i, c in enumerate(ix)], F.col("v").alias("w"))
        shared = [c for c in ix if c in have]
        df = df.join(right, names.columns(shared)) if shared else df.crossJoin(right)
        have += [c for c in ix if c not in have]
        df = df.select(*names.columns(have), a.times(F.col("v"), F.col("w"), t).alias("v"))
    if not set(spec.iy) <= set(have) or len(set(spec.iy)) != len(spec.iy):
        raise ValueError("output labels must differ and occur in an operand")
    return df.groupBy(*[F.col(names[c]).alias(f"d{i}") for i, c in enumerate(spec.iy)]).agg(a.plus(F.col("v"), t).alias("v"))
