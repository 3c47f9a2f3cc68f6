"""Contractions over values that are lists: the k best products of each cell, with what they are made of.

The carrier of this algebra is a list of at most k pairs (value, witness), best first; sums merge lists and keep k,
products combine all pairs of two lists and keep k. A cell's list is kept as rows, one for each of its members,
so that a sum is a ranking within the cell: Spark keeps the k best of each cell in every task before
rows are sent, and no list of a cell is gathered. The witness of a product is the
values of the summed labels, in the order of `labels`; ties go to the smaller witness, then none is dropped but
beyond k.

Members are products of the operands' cells under max-plus or min-plus (sums of numbers), best meaning
largest or smallest. k = 1 gives the tropical contraction with its winners.
"""

from __future__ import annotations

from collections.abc import Hashable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.algebra import Algebra
from ..functions.algebra import algebra as named
from ..plans.order import optimize
from ..plans.spec import EinsumSpec
from ..plans.tree import steps
from ..shared import stage
from ..sources.tensor import TensorRel
from .contract import STAGE_EVERY, Names, enter, prepared


def best(df: DataFrame, names: Names, labels: Sequence[Hashable], witness: Sequence[Hashable], a: Algebra, k: int) -> DataFrame:
    """The k best rows of each cell over labels; the witness breaks ties."""
    v = F.col("v").desc() if a.picks > 0 else F.col("v").asc()
    order = [v, *[F.col(names[c]) for c in witness]]
    by = Window.partitionBy(*names.columns(labels)) if labels else Window.partitionBy(F.lit(0))
    return df.withColumn("rank", F.row_number().over(by.orderBy(*order))).where(F.col("rank") <= k)


def k_best(spec: EinsumSpec | str, *tensors: TensorRel, k: int, algebra: str | Algebra = "maxplus", sizes=None) -> tuple[DataFrame, tuple]:
    """(relation (d0, ..., rank, v, w0, ...), labels of the witness): for each cell of the output its k best products.

    rank begins with 1; w0, ... are the values of the labels that are summed, in the order of the labels returned. Output
    labels must be different and stand in an operand.
    """
    a = named(algebra)
    if a.name not in ("maxplus", "minplus"):
        raise ValueError("the k best are found under max-plus or min-plus")
    if k < 1:
        raise ValueError("k must be at least 1")
    spec, names = prepared(spec, tensors, a, sizes)
    every = {c for x in spec.ixs for c in x}
    if len(set(spec.iy)) < len(spec.iy) or not set(spec.iy) <= every:
        raise ValueError("output labels must be different and stand in an operand")
    if spec.tree is None and len(tensors) > 1:
        spec = optimize(spec)
    witness = tuple(c for c in spec.sizes if c in every and c not in spec.iy)
    # label columns stay with a row as its witness after they are summed: kept holds the labels still to join on
    live = {}
    for i, (t, ix) in enumerate(zip(tensors, spec.ixs, strict=True)):
        x = enter(t, ix, names)
        live[i] = (x.df, list(x.labels), list(x.labels))
    df, kept, has = live[0]
    todo = steps(spec.tree, spec.ixs, spec.iy) if len(tensors) > 1 else []
    for i, s in enumerate(todo):
        (x, kx, hx), (y, ky, hy) = live.pop(s.left), live.pop(s.right)
        shared = [c for c in kx if c in ky]
        y = y.withColumnRenamed("v", "v2")
        both = x.join(y, names.columns(shared)) if shared else x.crossJoin(y)
        has = [*hx, *(c for c in hy if c not in shared)]
        df = both.select(*names.columns(has), (F.col("v") + F.col("v2")).cast(tensors[0].dtype.spark).alias("v"))
        kept = [c for c in dict.fromkeys([*kx, *ky]) if c in set(s.labels)]
        if len(kept) < len(set(kx) | set(ky)):  # labels are summed here: k for each cell go on
            df = best(df, names, kept, [c for c in has if c not in kept], a, k).drop("rank")
        if (i + 1) % STAGE_EVERY == 0 and i + 1 < len(todo):
            df = stage(df, "k-best")
        live[s.out] = (df, kept, has)
    df = best(df, names, spec.iy, witness, a, k)
    return df.select(*[F.col(names[c]).alias(f"d{i}") for i, c in enumerate(spec.iy)], "rank", "v", *[F.col(names[c]).alias(f"w{i}") for i, c in enumerate(witness)]), witness
