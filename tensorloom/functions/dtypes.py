"""Element types and the Spark types that carry them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class DType:
    """An element type: the Spark type, and the least and largest finite value (none for complex)."""

    name: str
    spark: str
    least: float | int | None = None
    most: float | int | None = None

    @property
    def is_complex(self) -> bool:
        return self.least is None

    @property
    def is_integer(self) -> bool:
        return isinstance(self.least, int)

    @property
    def part(self) -> str:
        """Spark type of one component."""
        return {"c32": "float", "c64": "double"}.get(self.name, self.spark)

    def lit(self, value) -> Column:
        if self.is_complex:
            z = complex(value)
            return F.struct(F.lit(z.real).cast(self.part).alias("re"), F.lit(z.imag).cast(self.part).alias("im"))
        return F.lit(str(value) if self.name == "u64" else value).cast(self.spark)

    def value(self, v):
        """A collected value as a Python number."""
        if self.is_complex:
            return complex(v["re"], v["im"])
        return int(v) if self.is_integer else float(v)


F32_MOST = 3.4028234663852886e38
F64_MOST = 1.7976931348623157e308

DTYPES = {
    d.name: d
    for d in (
        DType("f32", "float", -F32_MOST, F32_MOST),
        DType("f64", "double", -F64_MOST, F64_MOST),
        DType("i32", "int", -(2**31), 2**31 - 1),
        DType("i64", "bigint", -(2**63), 2**63 - 1),
        DType("u32", "bigint", 0, 2**32 - 1),
        DType("u64", "decimal(20,0)", 0, 2**64 - 1),
        DType("c32", "struct<re:float,im:float>"),
        DType("c64", "struct<re:double,im:double>"),
    )
}


def dtype(x: str | DType) -> DType:
    if isinstance(x, DType):
        return x
    if x not in DTYPES:
        raise ValueError(f"unknown element type {x!r}; one of {', '.join(DTYPES)}")
    return DTYPES[x]
