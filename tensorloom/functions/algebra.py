"""Semirings as builders of Column expressions.

An algebra gives the product of two values, the aggregate that adds up a group, and the two
neutral elements. A row that a tensor relation lacks stands for the neutral element of addition.
The tropical algebras fold from a finite extreme, so a group of infinities on the far side comes
out as that extreme (`clamp`).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dtypes import DType


@dataclass(frozen=True)
class Algebra:
    """times and plus work on columns; zero and one give Python values for an element type."""

    name: str
    times: Callable[[Column, Column, DType], Column]
    plus: Callable[[Column, DType], Column]
    zero: Callable[[DType], object]
    one: Callable[[DType], object]
    clamp: Callable[[Column, DType], Column]
    #: 1 if the largest value wins, -1 if the smallest does, 0 if values are summed.
    picks: int = 0
    #: Whether the derivative of a product is the other factor (else it is one).
    scales: bool = False
    admits_complex: bool = False

    @property
    def needs_argmax(self) -> bool:
        return self.picks != 0

    def check(self, t: DType) -> None:
        if t.is_complex and not self.admits_complex:
            raise ValueError(f"{self.name} needs ordered values; {t.name} has no order")

    def better(self, a: Column, b: Column) -> Column:
        """Whether a wins over b."""
        return a > b if self.picks > 0 else a < b

    def winner(self, v: Column, rank: Column, *rest: Column) -> Column:
        """Aggregate: the struct (v, rank, *rest) of the best value; the smallest rank on ties."""
        if self.picks > 0:
            return F.max(F.struct(v.alias("v"), (-rank).alias("rank"), *rest))
        return F.min(F.struct(v.alias("v"), rank.alias("rank"), *rest))

    def winner_rank(self, best: Column) -> Column:
        return -best["rank"] if self.picks > 0 else best["rank"]


def product(a: Column, b: Column, t: DType) -> Column:
    if t.is_complex:
        re = a["re"] * b["re"] - a["im"] * b["im"]
        im = a["re"] * b["im"] + a["im"] * b["re"]
        return F.struct(re.cast(t.part).alias("re"), im.cast(t.part).alias("im"))
    return (a * b).cast(t.spark)


def total(v: Column, t: DType) -> Column:
    """Sum in the element type; overflow of an integer type is an error under ANSI mode."""
    if t.is_complex:
        return F.struct(F.sum(v["re"]).cast(t.part).alias("re"), F.sum(v["im"]).cast(t.part).alias("im"))
    return F.sum(v).cast(t.spark)


def added(a: Column, b: Column, t: DType) -> Column:
    return (a + b).cast(t.spark)


def at_least(low: Callable[[DType], object]) -> Callable[[Column, DType], Column]:
    return lambda v, t: F.greatest(v, t.lit(low(t)))


STANDARD = Algebra("standard", product, total, lambda t: 0, lambda t: 1, lambda v, t: v, scales=True, admits_complex=True)
MAX_PLUS = Algebra("maxplus", added, lambda v, t: F.greatest(F.max(v), t.lit(t.least)), lambda t: t.least, lambda t: 0, at_least(lambda t: t.least), picks=1)
MIN_PLUS = Algebra("minplus", added, lambda v, t: F.least(F.min(v), t.lit(t.most)), lambda t: t.most, lambda t: 0, lambda v, t: F.least(v, t.lit(t.most)), picks=-1)
#: For values of at least 0; negative products count as 0.
MAX_MUL = Algebra("maxmul", product, lambda v, t: F.greatest(F.max(v), t.lit(0)), lambda t: 0, lambda t: 1, at_least(lambda t: 0), picks=1, scales=True)

ALGEBRAS = {a.name: a for a in (STANDARD, MAX_PLUS, MIN_PLUS, MAX_MUL)}


def algebra(x: str | Algebra) -> Algebra:
    if isinstance(x, Algebra):
        return x
    if x not in ALGEBRAS:
        raise ValueError(f"unknown algebra {x!r}; one of {', '.join(ALGEBRAS)}")
    return ALGEBRAS[x]


def custom(name: str, times, plus, zero, one, picks: int = 0) -> Algebra:
    """An algebra of one's own: times(a, b) and the aggregate plus(v) as Columns, zero and one as values.

    plus may be an aggregate expression of built-in functions or a grouped-aggregate pandas UDF; it
    must be commutative and associative, with zero as its neutral element, which annihilates products.
    """
    return Algebra(name, lambda a, b, t: times(a, b).cast(t.spark), lambda v, t: plus(v).cast(t.spark), lambda t: zero, lambda t: one, lambda v, t: v, picks=picks)


def is_zero(v: Column, a: Algebra, t: DType) -> Column:
    """Whether a value is the neutral element of addition."""
    z = t.lit(a.zero(t))
    return (v["re"] == z["re"]) & (v["im"] == z["im"]) if t.is_complex else v == z


def times_gradient(a: Algebra, x: Column, y: Column, g: Column, t: DType, scaled: bool | None = None) -> tuple[Column, Column]:
    """Gradients of x ⊗ y with respect to x and y, given that of the product."""
    if a.scales if scaled is None else scaled:
        return product(g, y, t), product(g, x, t)
    return g, g


def plus_gradient(a: Algebra, x: Column, y: Column, g: Column, t: DType) -> tuple[Column, Column]:
    """Gradients of x ⊕ y: both get it if values are summed, else the winner does, x on ties."""
    if not a.needs_argmax:
        return g, g
    y_wins, zero = a.better(y, x), t.lit(0)
    return F.when(y_wins, zero).otherwise(g), F.when(y_wins, g).otherwise(zero)
