"""Networks in slices: tasks evaluate a contraction tree with some labels fixed, and the parts are added up.

plans.slicing chooses the labels, so that every array of a task, operands included, stays below a
bound that doesn't grow with the network. Each operand's cells are put into blocks, one for each of the values of
its fixed labels; slices are numbered, batches of them are rows, and a batch meets the blocks that it
needs by a join, each block once. A batch adds its slices up before it sends the cells of its part
that aren't zero; Spark adds up the batches. Blocks and batches are tables, so that a lost executor
costs the work of its tasks.

Slices in which an operand has no cell are zero and aren't evaluated: the algebra's zero annihilates products.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import ALGEBRAS, Algebra
from ..functions.algebra import algebra as named
from ..plans.order import optimize
from ..plans.slicing import fixed, slice_labels
from ..plans.spec import EinsumSpec
from ..shared import drop_staged, ship_code, stage
from ..sources.tensor import TensorRel, coordinate, strides
from . import dense
from .contract import prepared

#: Batches of slices for each core at least, if there are as many slices.
BATCHES = 4
TYPES = ("f32", "f64", "c32", "c64")


@dataclass(frozen=True)
class Operand:
    """Where an operand's cells go: strides over its axes of the block's number (at) and of the place in it (lin).

    A label's first axis has the strides; first tells it for each axis, so that repeated labels select the diagonal.
    digits: for each fixed label, the stride of its value in the block's number (0: the operand lacks it).
    """

    tensor: int
    at: tuple[int, ...]
    lin: tuple[int, ...]
    first: tuple[int, ...]
    labels: tuple
    shape: tuple[int, ...]
    digits: tuple[int, ...]
    blocks: int


def operand(tensor: int, ix: Sequence, spec: EinsumSpec, labels: Sequence) -> Operand:
    distinct = list(dict.fromkeys(ix))
    cut, rest = [c for c in distinct if c in labels], [c for c in distinct if c not in labels]
    of = dict(zip(cut, strides([spec.sizes[c] for c in cut], "row_major"), strict=True))
    place = dict(zip(rest, strides([spec.sizes[c] for c in rest], "row_major"), strict=True))
    first = [ix.index(c) for c in ix]
    once = lambda table: tuple(table.get(c, 0) if first[i] == i else 0 for i, c in enumerate(ix))
    return Operand(tensor, once(of), once(place), tuple(first), tuple(rest), tuple(spec.sizes[c] for c in rest), tuple(of.get(c, 0) for c in labels), math.prod(spec.sizes[c] for c in cut))


def batch_size(operands: Sequence[Operand], n: int, cells: int, least: int) -> int:
    """Slices of a batch: as many as give `least` batches, unless their blocks' cells or their parts go beyond the bound."""
    held = lambda b: sum(min(b, o.blocks) * math.prod(o.shape) for o in operands)
    b = max(1, n // max(1, least))
    while b > 1 and held(b) > cells:
        b //= 2
    return b


def digits_of(numbers: np.ndarray, sizes: Sequence[int]) -> np.ndarray:
    """Values of the fixed labels of slices; the last label is the fastest."""
    return np.stack(np.unravel_index(numbers, sizes), axis=1) if sizes else np.zeros((len(numbers), 0), dtype=np.int64)


def gather(tensors: Sequence[TensorRel], operands: Sequence[Operand]) -> DataFrame:
    """(i, at, cells): each operand's blocks with their cells (lin, re, im)."""
    spark = tensors[0].df.sparkSession
    distinct = {o.tensor: tensors[o.tensor] for o in operands}
    uses = [(i, o.tensor, list(o.at), list(o.lin), list(o.first)) for i, o in enumerate(operands)]
    table = spark.createDataFrame(uses, "i int, tensor int, s_at array<long>, s_lin array<long>, first array<int>")
    todo = []
    for k, t in distinct.items():
        re, im = (F.col("v.re"), F.col("v.im")) if t.dtype.is_complex else (F.col("v"), F.lit(0.0))
        d = F.array(*[F.col(c).cast("bigint") for c in t.dims]) if t.dims else F.array().cast("array<bigint>")
        todo.append(t.df.select(F.lit(k).alias("tensor"), d.alias("d"), re.cast("double").alias("re"), im.cast("double").alias("im")))
    while len(todo) > 1:
        todo = [x.unionAll(y) for x, y in zip(todo[::2], todo[1::2], strict=False)] + todo[len(todo) - len(todo) % 2 :]
    dot = lambda s: F.aggregate(F.zip_with(s, "d", lambda a, b: a * b), F.lit(0).cast("bigint"), lambda a, x: a + x)
    # a row for each operand
    cells = todo[0].join(F.broadcast(table), "tensor")
    diagonal = F.forall(F.sequence(F.lit(0), F.size("first") - 1), lambda j: F.get("d", j) == F.get("d", F.get("first", j)))
    cells = cells.where((F.size("first") == 0) | diagonal).select("i", dot("s_at").alias("at"), F.struct(dot("s_lin").alias("lin"), "re", "im").alias("c"))
    return cells.groupBy("i", "at").agg(F.collect_list("c").alias("cells"))


def value(t, re: Column, im: Column) -> Column:
    return F.struct(re.cast(t.part).alias("re"), im.cast(t.part).alias("im")) if t.is_complex else re.cast(t.spark)


def execute(spec: EinsumSpec, tensors: Sequence[TensorRel], algebra_: str | Algebra = "standard", cells: int = dense.CELLS, labels: Sequence | None = None) -> TensorRel:
    """The result of the spec's tree (greedy if it has none), slice by slice; no array has more than `cells` cells.

    labels are those to fix, by default as many as the bound needs. The tropical products, which are formed
    before they are reduced, count too.
    """
    a = named(algebra_)
    spec, _ = prepared(spec, tensors, a)
    if ALGEBRAS.get(a.name) is not a:
        raise ValueError("slices are evaluated in the built-in algebras")
    t = tensors[0].dtype
    if t.name not in TYPES:
        raise ValueError(f"slices are evaluated in floating point, not in {t.name}")
    if spec.tree is None:
        spec = optimize(spec)
    labels = tuple(slice_labels(spec, cells) if labels is None else labels)
    if a.needs_argmax:  # room for products
        while len(labels) < len(spec.sizes) and dense.complexity(fixed(spec, labels)).tc > math.log2(dense.PRODUCTS):
            labels += (max((c for c in spec.sizes if c not in labels), key=lambda c: spec.sizes[c]),)
    spark = tensors[0].df.sparkSession
    ship_code(spark)
    seen: dict[int, int] = {}
    uses = [seen.setdefault(id(x.df), i) for i, x in enumerate(tensors)]
    operands = [operand(uses[i], ix, spec, labels) for i, ix in enumerate(spec.ixs)]
    sizes = [spec.sizes[c] for c in labels]
    n = math.prod(sizes)
    size = batch_size(operands, n, cells, BATCHES * spark.sparkContext.defaultParallelism)
    kinds = (np.complex64 if t.name == "c32" else np.complex128) if t.is_complex else (np.float32 if t.name == "f32" else np.float64)
    kind, zero = a.name, a.zero(t)
    # the output without fixed labels and repetitions; the whole place of a cell is put together below
    rest = [c for c in dict.fromkeys(spec.iy) if c not in labels]
    inner = EinsumSpec([o.labels for o in operands], rest, spec.sizes, spec.tree)
    whole = list(dict.fromkeys(spec.iy))
    step = dict(zip(whole, strides([spec.sizes[c] for c in whole]), strict=True))
    at_slice = np.array([step.get(c, 0) for c in labels], dtype=np.int64)
    inside = np.zeros([spec.sizes[c] for c in rest], dtype=np.int64)
    for k, c in enumerate(rest):
        inside += (np.arange(spec.sizes[c]) * step[c]).reshape([-1 if j == k else 1 for j in range(len(rest))])

    def batch_digits(b: int) -> np.ndarray:
        return digits_of(np.arange(b * size, min(n, (b + 1) * size)), sizes)

    def needed(batches):
        for rows in batches:
            for b in rows.column("batch").to_pylist():
                d = batch_digits(b)
                i, at = zip(*[(i, x) for i, o in enumerate(operands) for x in np.unique(d @ np.array(o.digits, dtype=np.int64)).tolist()], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([b] * len(i), pa.int64()), pa.array(i, pa.int32()), pa.array(at, pa.int64())], ["batch", "i", "at"])

    def run(table):
        blocks = {}
        for i, at, c in zip(table.column("i").to_pylist(), table.column("at").to_pylist(), table.column("cells"), strict=True):
            lin, re, im = (c.values.field(f).to_numpy(zero_copy_only=False) for f in ("lin", "re", "im"))
            x = np.full(math.prod(operands[i].shape), zero, dtype=kinds)
            x[lin] = re + 1j * im if t.is_complex else re
            blocks[i, at] = x.reshape(operands[i].shape)
        parts: dict[int, np.ndarray] = {}
        for d in batch_digits(table.column("batch")[0].as_py()):
            arrays = [blocks.get((i, int(d @ np.array(o.digits, dtype=np.int64)))) for i, o in enumerate(operands)]
            if any(x is None for x in arrays):
                continue
            with np.errstate(over="ignore", invalid="ignore"):
                found = np.asarray(dense.evaluate(inner, arrays, kind, zero))
            place = int(d @ at_slice)
            if place not in parts:
                parts[place] = np.array(found)
            elif kind == "standard":
                parts[place] += found
            else:
                (np.maximum if kind.startswith("max") else np.minimum)(parts[place], found, out=parts[place])
        lin, v = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=kinds)]
        for place, x in parts.items():
            some = x != zero
            lin.append(inside[some] + place)
            v.append(x[some])
        lin, v = np.concatenate(lin), np.concatenate(v)
        return pa.table({"lin": lin, "re": v.real.astype(np.float64), "im": (v.imag if t.is_complex else np.zeros(len(v))).astype(np.float64)})

    blocks = stage(gather(tensors, operands), "blocks")
    n_batches = -(-n // size)
    wanted = spark.range(n_batches).withColumnRenamed("id", "batch").mapInArrow(needed, "batch long, i int, at long")
    wanted = wanted.join(blocks.hint("shuffle_hash"), ["i", "at"])
    found = wanted.groupBy("batch").applyInArrow(run, "lin long, re double, im double")
    found = stage(found, "slices")
    drop_staged(spark, blocks)
    if kind == "standard":
        found = found.groupBy("lin").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    else:
        found = found.groupBy("lin").agg((F.max if kind.startswith("max") else F.min)("re").alias("re"), F.lit(0.0).alias("im"))
    if not spec.iy:  # a scalar has its one row even if all slices are zero
        re = F.coalesce(F.max("re"), F.lit(float(zero))).alias("re")
        found = found.agg(F.lit(0).cast("bigint").alias("lin"), re, F.coalesce(F.max("im"), F.lit(0.0)).alias("im"))
    of = dict(zip(whole, strides([spec.sizes[c] for c in whole]), strict=True))
    coords = [coordinate(F.col("lin"), of[c], spec.sizes[c]).alias(f"d{k}") for k, c in enumerate(spec.iy)]
    return TensorRel(found.select(*coords, value(t, F.col("re"), F.col("im")).alias("v")), [spec.sizes[c] for c in spec.iy], t)
