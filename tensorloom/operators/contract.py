"""Unary and binary contraction of tensor relations, and trees of them.

A contraction is an equi-join on the shared labels, a product, and a grouped aggregate by the
labels that go on. Labels that only one operand has and that don't go on are added up below the
join. Everything is a lazy DataFrame; Catalyst and adaptive execution choose the physical plan.
Operands whose dense size is bounded by BROADCAST_CELLS are offered for broadcast, others shuffle.
Where two large operands have a large result, rows are dealt by it, so that products aren't shuffled.
Long trees write an intermediate result to the shared folder every STAGE_EVERY contractions.
"""

from __future__ import annotations

import math
from collections.abc import Hashable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import STANDARD, Algebra, algebra
from ..functions.algebra import algebra as named
from ..functions.dtypes import DType, dtype
from ..plans.order import optimize
from ..plans.sparse import by_rows
from ..plans.spec import EinsumSpec, parse
from ..plans.tree import left_deep, steps
from ..shared import stage
from ..sources.tensor import TensorRel, strides, with_axis

#: An operand of at most so many cells may be broadcast: about 16 bytes for each label and cell.
BROADCAST_CELLS = 1 << 17
#: Results of up to so many cells are added up before the shuffle; larger ones are dealt by result, in ranges of
#: about so many products, at most so many ranges.
SMALL_RESULT = 1 << 22
PRODUCTS = 1 << 23
RANGES = 1 << 14
STAGE_EVERY = 8


@dataclass
class Labelled:
    """A relation whose coordinate columns are named by label, each label once."""

    df: DataFrame
    labels: tuple[Hashable, ...]
    dtype: DType


class Names:
    """Column names for labels."""

    def __init__(self, sizes):
        self.sizes = dict(sizes)
        self.ids = {c: i for i, c in enumerate(self.sizes)}

    def __getitem__(self, label) -> str:
        return f"l{self.ids[label]}"

    def columns(self, labels) -> list[str]:
        return [self[c] for c in labels]

    def cells(self, labels) -> int:
        return math.prod(self.sizes[c] for c in labels)

    def linear(self, labels: Sequence) -> Column:
        """Column-major linear index over labels."""
        out = F.lit(0).cast("bigint")
        for c, s in zip(labels, strides([self.sizes[c] for c in labels]), strict=True):
            out = out + F.col(self[c]) * s
        return out

    def decode(self, df: DataFrame, index: str, labels: Sequence) -> DataFrame:
        """Coordinates of labels from a linear index over them."""
        for c, s in zip(labels, strides([self.sizes[c] for c in labels]), strict=True):
            df = df.withColumn(self[c], F.pmod(F.call_function("div", F.col(index), F.lit(s).cast("bigint")), F.lit(max(1, self.sizes[c])).cast("bigint")))
        return df


def enter(t: TensorRel, ix: Sequence, names: Names) -> Labelled:
    """Name a tensor's axes; a label that occurs again selects the diagonal."""
    if len(ix) != t.ndim:
        raise ValueError(f"{len(ix)} labels for rank {t.ndim}")
    first: dict[Hashable, int] = {}
    df = t.df
    for i, c in enumerate(ix):
        if first.setdefault(c, i) != i:
            df = df.where(F.col(f"d{i}") == F.col(f"d{first[c]}"))
    return Labelled(df.select(*[F.col(f"d{i}").alias(names[c]) for c, i in first.items()], "v"), tuple(first), t.dtype)


def reduce_to(x: Labelled, keep: Sequence, names: Names, a: Algebra) -> Labelled:
    """Add up over labels that are not in keep; a scalar has its one row even if x is empty."""
    labels = tuple(c for c in x.labels if c in set(keep))
    if len(labels) == len(x.labels):
        return x
    v = a.plus(F.col("v"), x.dtype)
    if labels:
        return Labelled(x.df.groupBy(*names.columns(labels)).agg(v.alias("v")), labels, x.dtype)
    return Labelled(x.df.agg(F.coalesce(v, x.dtype.lit(a.zero(x.dtype))).alias("v")), (), x.dtype)


def leave(x: Labelled, iy: Sequence, names: Names, a: Algebra, clamp: bool = True) -> TensorRel:
    """The tensor with axes iy: adds up labels not in it, repeats along new ones, puts repeated ones on the diagonal."""
    x = reduce_to(x, iy, names, a)
    df = x.df
    for c in dict.fromkeys(iy):
        if c not in x.labels:
            df = with_axis(df, names[c], names.sizes[c])
    v = a.clamp(F.col("v"), x.dtype) if clamp else F.col("v")
    return TensorRel(df.select(*[F.col(names[c]).alias(f"d{i}") for i, c in enumerate(iy)], v.alias("v")), [names.sizes[c] for c in iy], x.dtype)


def product(x: Labelled, y: Labelled, names: Names, a: Algebra) -> Labelled:
    """Join on the shared labels and multiply; all labels go on."""
    if x.dtype != y.dtype:
        raise ValueError(f"operands of types {x.dtype.name} and {y.dtype.name}")
    shared = [c for c in x.labels if c in y.labels]
    own = lambda z, v: z.df.select(*[F.col(n).alias(n) for n in names.columns(z.labels)], F.col("v").alias(v))
    left, right = own(x, "va"), own(y, "vb")
    n_left, n_right = names.cells(x.labels), names.cells(y.labels)
    if min(n_left, n_right) <= BROADCAST_CELLS:
        left, right = (F.broadcast(left), right) if n_left < n_right else (left, F.broadcast(right))
    both = left.join(right, names.columns(shared)) if shared else left.crossJoin(right)
    labels = tuple(dict.fromkeys([*x.labels, *y.labels]))
    return Labelled(both.select(*names.columns(labels), a.times(F.col("va"), F.col("vb"), x.dtype).alias("v")), labels, x.dtype)


def pairwise(x: Labelled, y: Labelled, out: Sequence, names: Names, a: Algebra) -> Labelled:
    """Contract two relations; of the labels those in out go on."""
    keep = set(out)
    x = reduce_to(x, [c for c in x.labels if c in keep or c in y.labels], names, a)
    y = reduce_to(y, [c for c in y.labels if c in keep or c in x.labels], names, a)
    ranges = result_ranges(x, y, keep, names)
    if ranges > 1:
        return by_result(x, y, keep, names, a, ranges)
    z = product(x, y, names, a)
    if set(z.labels) <= keep:
        return Labelled(z.df.withColumn("v", a.clamp(F.col("v"), z.dtype)), z.labels, z.dtype)
    return reduce_to(z, out, names, a)


def result_ranges(x: Labelled, y: Labelled, keep: set, names: Names) -> int:
    """How many ranges of the result have about PRODUCTS products each, by a count; 1 if the result or an operand is small."""
    shared = [c for c in x.labels if c in y.labels]
    result = [c for c in dict.fromkeys([*x.labels, *y.labels]) if c in keep]
    if set(shared) <= keep or min(names.cells(x.labels), names.cells(y.labels)) <= BROADCAST_CELLS or names.cells(result) <= SMALL_RESULT or set(x.labels) <= set(y.labels) or set(y.labels) <= set(x.labels):
        return 1
    columns = names.columns(shared)
    rows = lambda z, n: z.df.groupBy(*columns).agg(F.count("*").cast("double").alias(n))
    products = rows(x, "n").join(rows(y, "m"), columns).agg(F.sum(F.col("n") * F.col("m"))).collect()[0][0] or 0
    return int(min(RANGES, -(-products // PRODUCTS)))


def by_result(x: Labelled, y: Labelled, keep: set, names: Names, a: Algebra, ranges: int) -> Labelled:
    """The contraction with the rows of x dealt by ranges of the labels that x alone has.

    Rows of y go to the ranges in which x has the values of their shared labels, no others. All products of a cell of the
    result are made and added up in the task of its range, so none is shuffled, and a value of the shared labels
    with many rows is spread. Ranges are even parts of the span of those labels' place; where places lie
    unevenly, so does the work.
    """
    shared, own = names.columns([c for c in x.labels if c in y.labels]), [c for c in x.labels if c not in y.labels]
    place = names.linear(own)
    low, high = x.df.agg(F.min(place), F.max(place)).collect()[0]
    if low is None:
        ranges, low, high = 1, 0, 0
    width = -(-(high - low + 1) // ranges)
    left = x.df.withColumn("g", F.call_function("div", place - F.lit(low).cast("bigint"), F.lit(width).cast("bigint"))).withColumnRenamed("v", "va")
    right = y.df.withColumnRenamed("v", "vb").join(left.select("g", *shared).distinct(), shared)
    # else the join on (g, shared labels) has its sides, which lie by g, dealt by all its keys, and the products too
    x.df.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    tasks = max(2 * ranges, int(x.df.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # fewer would be dealt again
    both = left.repartition(tasks, "g").join(right.repartition(tasks, "g").hint("merge"), ["g", *shared])
    labels = tuple(c for c in dict.fromkeys([*x.labels, *y.labels]) if c in keep)
    z = both.select("g", *names.columns(labels), a.times(F.col("va"), F.col("vb"), x.dtype).alias("v"))
    return Labelled(z.groupBy("g", *names.columns(labels)).agg(a.plus(F.col("v"), x.dtype).alias("v")).drop("g"), labels, x.dtype)


def pairwise_best(x: Labelled, y: Labelled, out: Sequence, names: Names, a: Algebra) -> tuple[DataFrame, tuple, tuple]:
    """As pairwise, with the winner: (rows (labels, v, k), labels, contracted labels).

    k is the column-major linear index over the contracted labels in the order in which x has
    them; the smallest wins ties, and k is 0 where no product is better than the algebra's zero.
    """
    keep = set(out)
    contracted = tuple(c for c in x.labels if c in y.labels and c not in keep)
    z = product(x, y, names, a)
    labels = tuple(c for c in z.labels if c in keep)
    best = a.winner(F.col("v"), names.linear(contracted)).alias("best")
    df = z.df.groupBy(*names.columns(labels)).agg(best) if labels else z.df.agg(best)
    zero = z.dtype.lit(a.zero(z.dtype))
    v = F.coalesce(F.col("best.v"), zero)
    k = F.when(a.better(v, zero), a.winner_rank(F.col("best"))).otherwise(F.lit(0).cast("bigint"))
    return df.select(*names.columns(labels), a.clamp(v, z.dtype).alias("v"), k.alias("k")), labels, contracted


def pairwise_argmax(x: Labelled, y: Labelled, out: Sequence, names: Names, a: Algebra) -> tuple[Labelled, DataFrame, tuple]:
    """pairwise_best in two: (result, rows (labels, k), contracted labels)."""
    df, labels, contracted = pairwise_best(x, y, out, names, a)
    return Labelled(df.drop("k"), labels, x.dtype), df.drop("v"), contracted


def reduce_best(x: Labelled, iy: Sequence, names: Names, a: Algebra) -> tuple[DataFrame, tuple, tuple]:
    """As reduce_to, with the winner: (rows (labels, v, k), labels, dropped labels in order of appearance)."""
    labels = tuple(c for c in x.labels if c in set(iy))
    dropped = tuple(c for c in x.labels if c not in set(iy))
    best = a.winner(F.col("v"), names.linear(dropped)).alias("best")
    df = x.df.groupBy(*names.columns(labels)).agg(best) if labels else x.df.agg(best)
    zero = x.dtype.lit(a.zero(x.dtype))
    k = F.coalesce(a.winner_rank(F.col("best")), F.lit(0).cast("bigint"))
    return df.select(*names.columns(labels), a.clamp(F.coalesce(F.col("best.v"), zero), x.dtype).alias("v"), k.alias("k")), labels, dropped


def reduce_argmax(x: Labelled, iy: Sequence, names: Names, a: Algebra) -> tuple[Labelled, DataFrame, tuple]:
    """reduce_best in two: (result, rows (labels, k), dropped labels)."""
    df, labels, dropped = reduce_best(x, iy, names, a)
    return Labelled(df.drop("k"), labels, x.dtype), df.drop("v"), dropped


def prepared(spec: EinsumSpec | str, tensors: Sequence[TensorRel], a: Algebra, sizes=None) -> tuple[EinsumSpec, Names]:
    spec = parse(spec, sizes) if isinstance(spec, str) else spec
    if sizes:
        spec = spec.with_sizes(sizes)
    spec = spec.bind([t.shape for t in tensors])
    for t in tensors:
        a.check(t.dtype)
        if t.dtype != tensors[0].dtype:
            raise ValueError(f"operands of types {tensors[0].dtype.name} and {t.dtype.name}")
    return spec, Names(spec.sizes)


def unary(t: TensorRel, ix: Sequence, iy: Sequence, algebra_: str | Algebra = STANDARD, sizes=None) -> TensorRel:
    """One operand: trace, diagonal, sums, permutation, repetition, diagonal embedding."""
    a = algebra(algebra_)
    spec, names = prepared(EinsumSpec((tuple(ix),), tuple(iy)), [t], a, sizes)
    return leave(enter(t, spec.ixs[0], names), spec.iy, names, a)


def unary_with_argmax(t: TensorRel, ix: Sequence, iy: Sequence, algebra_: str | Algebra, sizes=None) -> tuple[TensorRel, TensorRel]:
    """unary, and for each cell of the result the column-major position of the winner in t."""
    a = algebra(algebra_)
    if not a.needs_argmax:
        raise ValueError(f"{a.name} has no winner")
    spec, names = prepared(EinsumSpec((tuple(ix),), tuple(iy)), [t], a, sizes)
    x = enter(t, spec.ixs[0], names)
    y, winners, dropped = reduce_argmax(x, spec.iy, names, a)
    at = names.decode(winners, "k", dropped)
    position = names.linear(spec.ixs[0]).alias("v")
    at = at.select(*names.columns(y.labels), position)
    return leave(y, spec.iy, names, a), leave(Labelled(at, y.labels, dtype("i64")), spec.iy, names, STANDARD)


def contract_binary(t: TensorRel, other: TensorRel, ia: Sequence, ib: Sequence, iy: Sequence, algebra_: str | Algebra = STANDARD, sizes=None) -> TensorRel:
    """Two operands under any labels."""
    a = algebra(algebra_)
    spec, names = prepared(EinsumSpec((tuple(ia), tuple(ib)), tuple(iy)), [t, other], a, sizes)
    z = pairwise(enter(t, spec.ixs[0], names), enter(other, spec.ixs[1], names), spec.iy, names, a)
    return leave(z, spec.iy, names, a)


def contract_binary_with_argmax(t: TensorRel, other: TensorRel, ia: Sequence, ib: Sequence, iy: Sequence, algebra_: str | Algebra, sizes=None) -> tuple[TensorRel, TensorRel]:
    """contract_binary, and for each cell the winner over the contracted labels."""
    a = algebra(algebra_)
    if not a.needs_argmax:
        raise ValueError(f"{a.name} has no winner")
    spec, names = prepared(EinsumSpec((tuple(ia), tuple(ib)), tuple(iy)), [t, other], a, sizes)
    x, y = enter(t, spec.ixs[0], names), enter(other, spec.ixs[1], names)
    keep = set(spec.iy)
    x = reduce_to(x, [c for c in x.labels if c in keep or c in y.labels], names, a)
    y = reduce_to(y, [c for c in y.labels if c in keep or c in x.labels], names, a)
    z, winners, _ = pairwise_argmax(x, y, spec.iy, names, a)
    k = Labelled(winners.withColumnRenamed("k", "v"), z.labels, dtype("i64"))
    return leave(z, spec.iy, names, a), leave(k, spec.iy, names, STANDARD)


def with_winners(tensors: Sequence[TensorRel], ixs: Sequence[Sequence], iy: Sequence, algebra_: str | Algebra, sizes=None) -> DataFrame:
    """One or two operands contracted: one relation (d0, ..., v, k) of values and winners, from one aggregate.

    k is as in unary_with_argmax or contract_binary_with_argmax. Output labels must be different and stand in an operand.
    """
    a = algebra(algebra_)
    if not a.needs_argmax:
        raise ValueError(f"{a.name} has no winner")
    spec, names = prepared(EinsumSpec(tuple(map(tuple, ixs)), tuple(iy)), tensors, a, sizes)
    if len(set(spec.iy)) < len(spec.iy) or not set(spec.iy) <= {c for x in spec.ixs for c in x} or len(tensors) > 2:
        raise ValueError("values and winners in one relation: one or two operands, different output labels that they have")
    x = enter(tensors[0], spec.ixs[0], names)
    if len(tensors) == 1:
        df, labels, dropped = reduce_best(x, spec.iy, names, a)
        df = names.decode(df, "k", dropped).withColumn("k", names.linear(spec.ixs[0]))
    else:
        y, keep = enter(tensors[1], spec.ixs[1], names), set(spec.iy)
        x = reduce_to(x, [c for c in x.labels if c in keep or c in y.labels], names, a)
        y = reduce_to(y, [c for c in y.labels if c in keep or c in x.labels], names, a)
        df, labels, _ = pairwise_best(x, y, spec.iy, names, a)
    return df.select(*[F.col(names[c]).alias(f"d{i}") for i, c in enumerate(spec.iy)], "v", "k")


def execute(spec: EinsumSpec, tensors: Sequence[TensorRel], algebra_: str | Algebra = STANDARD, winners: list | None = None) -> TensorRel:
    """Contract by the spec's tree, from left to right if it has none.

    If winners is a list, each contraction's argmax tensor is added to it in post-order, and one
    for a last reduction of the root.
    """
    a = algebra(algebra_)
    spec, names = prepared(spec, tensors, a)
    live = {i: enter(t, ix, names) for i, (t, ix) in enumerate(zip(tensors, spec.ixs, strict=True))}
    root = live.get(0)
    todo = steps(spec.tree or left_deep(len(spec.ixs)), spec.ixs, spec.iy) if len(spec.ixs) > 1 else []
    for i, s in enumerate(todo):
        x, y = live.pop(s.left), live.pop(s.right)
        if winners is None:
            z = pairwise(x, y, s.labels, names, a)
        else:
            keep = set(s.labels)
            x = reduce_to(x, [c for c in x.labels if c in keep or c in y.labels], names, a)
            y = reduce_to(y, [c for c in y.labels if c in keep or c in x.labels], names, a)
            z, rows, _ = pairwise_argmax(x, y, s.labels, names, a)
            winners.append(leave(Labelled(rows.withColumnRenamed("k", "v"), z.labels, dtype("i64")), z.labels, names, STANDARD))
        if (i + 1) % STAGE_EVERY == 0 and i + 1 < len(todo):
            z = Labelled(stage(z.df, "contraction"), z.labels, z.dtype)
        live[s.out] = root = z
    if winners is not None and set(root.labels) - set(spec.iy):
        _, rows, dropped = reduce_argmax(root, spec.iy, names, a)
        at = names.decode(rows, "k", dropped)
        kept = tuple(c for c in root.labels if c in set(spec.iy))
        winners.append(leave(Labelled(at.select(*names.columns(kept), names.linear(root.labels).alias("v")), kept, dtype("i64")), spec.iy, names, STANDARD))
    return leave(root, spec.iy, names, a)


def einsum(spec: EinsumSpec | str, *tensors: TensorRel, algebra: str | Algebra = STANDARD, sizes=None, method: str = "greedy", strategy: str = "auto") -> TensorRel:
    """Contract tensors by an expression such as "ij,jk->ik" or a spec; sizes for labels that no operand has.

    strategy: "relational" builds joins and aggregates; "dense" evaluates the tree on arrays in one
    task, for networks of many small tensors; "sliced" does so in many tasks, with labels fixed until
    arrays are small enough; "auto" takes "dense" from DENSE_FROM operands if its memory bound holds,
    else "relational". method: an order by "greedy", "treesa" or "left_deep" from the sizes, or by "rows",
    from what the operands hold, which takes a job for each different one.
    """
    from . import dense, sliced

    a = named(algebra)
    spec, _ = prepared(spec, tensors, a, sizes)
    if spec.tree is None:
        spec = by_rows(spec, tensors) if method == "rows" else optimize(spec, method)
    if strategy not in ("auto", "relational", "dense", "sliced"):
        raise ValueError(f"unknown strategy {strategy!r}")
    if strategy == "sliced":
        return sliced.execute(spec, tensors, a, cells=dense.CELLS)
    if strategy == "dense" or strategy == "auto" and dense.suits(spec, tensors, a):
        return dense.execute(spec, tensors, a)
    return execute(spec, tensors, a)


def execute_with_argmax(spec: EinsumSpec | str, *tensors: TensorRel, algebra: str | Algebra, sizes=None) -> tuple[TensorRel, list[TensorRel]]:
    """The result and the argmax tensors of all contractions in post-order."""
    a = named(algebra)
    if not a.needs_argmax:
        raise ValueError(f"{a.name} has no winner")
    spec, _ = prepared(spec, tensors, a, sizes)
    winners: list[TensorRel] = []
    return execute(spec if spec.tree else optimize(spec), tensors, a, winners), winners
