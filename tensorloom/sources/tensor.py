"""Tensors as relations: coordinate columns d0 ... d{n-1} and a value column v."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.algebra import STANDARD, Algebra, algebra
from ..functions.dtypes import DType, dtype

#: Values that from_data sends from the driver in one row's array.
CHUNK = 65_536
#: Up to this size a new axis is made by exploding a literal sequence.
EXPLODED = 1 << 20


def strides(shape: Sequence[int], order: str = "col_major") -> list[int]:
    """Steps of the linear index for each axis; the first axis is the fastest in col_major."""
    out, step = [0] * len(shape), 1
    axes = range(len(shape)) if order == "col_major" else range(len(shape) - 1, -1, -1)
    for i in axes:
        out[i], step = step, step * shape[i]
    return out


def linear(coords: Sequence[Column], shape: Sequence[int], order: str = "col_major") -> Column:
    out = F.lit(0).cast("bigint")
    for c, s in zip(coords, strides(shape, order), strict=True):
        out = out + c * s
    return out


def coordinate(index: Column, step: int, size: int) -> Column:
    """Coordinate along an axis of `size` with `step` of a linear index."""
    return F.pmod(F.call_function("div", index, F.lit(step).cast("bigint")), F.lit(max(size, 1)).cast("bigint"))


def with_axis(df: DataFrame, name: str, size: int) -> DataFrame:
    """Each row once for each value 0 ... size - 1 of a new column."""
    if size <= EXPLODED:
        return df.withColumn(name, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(size - 1).cast("bigint")))) if size else df.withColumn(name, F.lit(0).cast("bigint")).where(F.lit(False))
    return df.crossJoin(df.sparkSession.range(size).withColumnRenamed("id", name))


class TensorRel:
    """A tensor: a DataFrame of its non-zero cells, with shape and element type kept beside it.

    Cells without a row hold the zero of the algebra in use. Coordinates are unique.
    """

    def __init__(self, df: DataFrame, shape: Sequence[int], dtype_: str | DType = "f64"):
        self.df, self.shape, self.dtype = df, tuple(int(n) for n in shape), dtype(dtype_)
        names = [*(f"d{i}" for i in range(len(self.shape))), "v"]
        if sorted(df.columns) != sorted(names):
            raise ValueError(f"a tensor of rank {len(self.shape)} needs the columns {names}, not {df.columns}")
        if any(n < 0 for n in self.shape):
            raise ValueError(f"negative size in {self.shape}")

    # ---- sources

    @classmethod
    def from_data(cls, spark: SparkSession, data: Sequence, shape: Sequence[int], dtype_: str | DType = "f64", order: str = "col_major") -> TensorRel:
        """All cells, listed in linear order."""
        t, shape = dtype(dtype_), tuple(shape)
        if len(data) != math.prod(shape):
            raise ValueError(f"data of length {len(data)} doesn't match shape {list(shape)}")
        plain = (lambda x: (complex(x).real, complex(x).imag)) if t.is_complex else (int if t.is_integer else float)
        element = "struct<re:double,im:double>" if t.is_complex else "decimal(20,0)" if t.name == "u64" else "bigint" if t.is_integer else "double"
        if t.name == "u64":
            from decimal import Decimal

            plain = Decimal
        rows = [(i, [plain(x) for x in data[i : i + CHUNK]]) for i in range(0, len(data), CHUNK)]
        df = spark.createDataFrame(rows, f"base bigint, data array<{element}>").select("base", F.posexplode("data").alias("pos", "v"))
        lin = F.col("base") + F.col("pos")
        coords = [coordinate(lin, s, n).alias(f"d{i}") for i, (s, n) in enumerate(zip(strides(shape, order), shape, strict=True))]
        return cls(df.select(*coords, F.col("v").cast(t.spark).alias("v")), shape, t)

    @classmethod
    def from_table(cls, df: DataFrame, dims: Sequence[str | Column], value: str | Column, shape: Sequence[int] | None = None, dtype_: str | DType = "i64", algebra_: str | Algebra = STANDARD) -> TensorRel:
        """Rows of a table added up by their coordinates; null coordinates take no part.

        Sizes not given are one more than the largest coordinate.
        """
        t = dtype(dtype_)
        names = [f"d{i}" for i in range(len(dims))]
        as_column = lambda c: F.col(c) if isinstance(c, str) else c
        d = df.select(*[as_column(c).cast("bigint").alias(n) for c, n in zip(dims, names, strict=True)], as_column(value).cast(t.spark).alias("v"))
        for n in names:
            d = d.where(F.col(n).isNotNull())
        if shape is None:  # from the rows: their grouping would be run twice
            top = d.agg(*[F.max(n).alias(n) for n in names]).collect()[0] if names else []
            shape = [0 if x is None else x + 1 for x in top]
        return cls(d.groupBy(*names).agg(algebra(algebra_).plus(F.col("v"), t).alias("v")), shape, t)

    @classmethod
    def zeros(cls, spark: SparkSession, shape: Sequence[int], dtype_: str | DType = "f64") -> TensorRel:
        """All cells with the number 0, which is not the zero of every algebra."""
        t = dtype(dtype_)
        return cls.scalar(spark, 0, t).grow([], shape)

    @classmethod
    def scalar(cls, spark: SparkSession, value, dtype_: str | DType = "f64") -> TensorRel:
        t = dtype(dtype_)
        return cls(spark.range(1).select(t.lit(value).alias("v")), (), t)

    @classmethod
    def from_storage(cls, df: DataFrame, shape: Sequence[int], dtype_: str | DType = "f64") -> TensorRel:
        """A flat relation (lin, v) in column-major order; its number of rows must match the shape."""
        shape = tuple(shape)
        n = df.count()
        if n != math.prod(shape):
            raise ValueError(f"storage of length {n} doesn't match shape {list(shape)}")
        coords = [coordinate(F.col("lin"), s, k).alias(f"d{i}") for i, (s, k) in enumerate(zip(strides(shape), shape, strict=True))]
        return cls(df.select(*coords, F.col("v").cast(dtype(dtype_).spark).alias("v")), shape, dtype_)

    # ---- metadata

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def numel(self) -> int:
        return math.prod(self.shape)

    @property
    def strides(self) -> list[int]:
        return strides(self.shape)

    @property
    def dims(self) -> list[str]:
        return [f"d{i}" for i in range(self.ndim)]

    @property
    def is_contiguous(self) -> bool:
        """Always: a relation has no memory layout."""
        return True

    def contiguous(self) -> TensorRel:
        return self

    def __repr__(self) -> str:
        return f"TensorRel(shape={list(self.shape)}, dtype={self.dtype.name})"

    # ---- views

    def permute(self, axes: Sequence[int]) -> TensorRel:
        axes = list(axes)
        if len(axes) != self.ndim:
            raise ValueError(f"{len(axes)} axes for a tensor of rank {self.ndim}")
        if any(not 0 <= a < self.ndim for a in axes):
            raise ValueError(f"axis out of range in {axes}")
        if len(set(axes)) != len(axes):
            raise ValueError(f"an axis occurs twice in {axes}")
        return TensorRel(self.df.select(*[F.col(f"d{a}").alias(f"d{i}") for i, a in enumerate(axes)], "v"), [self.shape[a] for a in axes], self.dtype)

    def t(self) -> TensorRel:
        if self.ndim != 2:
            raise ValueError("a transpose needs two axes")
        return self.permute([1, 0])

    def linear(self, order: str = "col_major") -> Column:
        return linear([F.col(d) for d in self.dims], self.shape, order)

    def reshape(self, shape: Sequence[int]) -> TensorRel:
        """The cells in the same column-major order under another shape."""
        shape = tuple(shape)
        if math.prod(shape) != self.numel:
            raise ValueError(f"{list(self.shape)} can't be reshaped to {list(shape)}")
        d = self.df.select(self.linear().alias("lin"), "v")
        coords = [coordinate(F.col("lin"), s, n).alias(f"d{i}") for i, (s, n) in enumerate(zip(strides(shape), shape, strict=True))]
        return TensorRel(d.select(*coords, "v"), shape, self.dtype)

    def diagonal(self) -> TensorRel:
        if self.ndim != 2 or self.shape[0] != self.shape[1]:
            raise ValueError("a diagonal needs two axes of one size")
        return TensorRel(self.df.where("d0 = d1").select("d0", "v"), self.shape[:1], self.dtype)

    def grow(self, before: Sequence[int], after: Sequence[int]) -> TensorRel:
        """Repeat along new axes before and after the old ones."""
        d = self.df.select(*[F.col(n).alias(f"d{i + len(before)}") for i, n in enumerate(self.dims)], "v")
        shape = [*before, *self.shape, *after]
        for i, n in enumerate(shape):
            if not len(before) <= i < len(before) + self.ndim:
                d = with_axis(d, f"d{i}", n)
        return TensorRel(d.select(*[f"d{i}" for i in range(len(shape))], "v"), shape, self.dtype)

    # ---- sums

    def sum(self, algebra_: str | Algebra = STANDARD) -> TensorRel:
        a = algebra(algebra_)
        a.check(self.dtype)
        v = F.coalesce(a.plus(F.col("v"), self.dtype), self.dtype.lit(a.zero(self.dtype)))
        return TensorRel(self.df.agg(v.alias("v")), (), self.dtype)

    def sum_axis(self, axis: int, algebra_: str | Algebra = STANDARD) -> TensorRel:
        if not 0 <= axis < self.ndim:
            raise ValueError(f"no axis {axis} in rank {self.ndim}")
        a = algebra(algebra_)
        a.check(self.dtype)
        if self.ndim == 1:
            return self.sum(a)
        rest = [i for i in range(self.ndim) if i != axis]
        d = self.df.groupBy(*[F.col(f"d{i}").alias(f"d{k}") for k, i in enumerate(rest)]).agg(a.plus(F.col("v"), self.dtype).alias("v"))
        return TensorRel(d, [self.shape[i] for i in rest], self.dtype)

    # ---- dense form and read-back

    def to_dense(self, algebra_: str | Algebra = STANDARD) -> TensorRel:
        """A row for every cell; missing ones hold the algebra's zero."""
        zero = self.dtype.lit(algebra(algebra_).zero(self.dtype))
        grid = self.df.sparkSession.range(self.numel)
        grid = grid.select(*[coordinate(F.col("id"), s, n).alias(f"d{i}") for i, (s, n) in enumerate(zip(self.strides, self.shape, strict=True))])
        if not self.dims:
            return TensorRel(self.df.agg(F.coalesce(F.first("v"), zero).alias("v")), (), self.dtype)
        d = grid.join(self.df, self.dims, "left")
        return TensorRel(d.select(*self.dims, F.coalesce("v", zero).alias("v")), self.shape, self.dtype)

    def to_list(self, algebra_: str | Algebra = STANDARD, order: str = "col_major") -> list:
        """All cells on the driver, in linear order; for results of a size that fits there."""
        out = [algebra(algebra_).zero(self.dtype)] * self.numel
        if self.dtype.is_complex:
            out = [complex(x) for x in out]
        for r in self.df.select(self.linear(order).alias("lin"), "v").toLocalIterator():
            out[r["lin"]] = self.dtype.value(r["v"])
        return out

    def get(self, index: int, algebra_: str | Algebra = STANDARD):
        """The cell at a column-major linear index."""
        if not 0 <= index < self.numel:
            raise IndexError(f"cell {index} of {self.numel}")
        found = self.df.where(self.linear() == index).select("v").take(1)
        return self.dtype.value(found[0]["v"]) if found else algebra(algebra_).zero(self.dtype)

    def item(self, algebra_: str | Algebra = STANDARD):
        """The value of a scalar."""
        if self.numel != 1:
            raise ValueError(f"{self} isn't a scalar")
        return self.to_list(algebra_)[0]
