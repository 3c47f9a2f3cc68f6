"""JSON documents of tensors that are larger than the driver, read and written by tasks.

A document is a file, or a folder of parts whose bytes in the order of their names are one document.
Reading splits it at commas: a task gets a range of bytes as pieces of text, and a piece that is a number alone is an
element of an array. All other pieces, a few for each tensor, come to the driver with their
places; joined together, with a mark for each stretch of numbers between them, they are a small JSON text that
tells which stretch is whose data. Writing gives every literal and number a place and sorts by it.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dtypes import dtype
from ..shared import stage
from .tensor import TensorRel, coordinate, strides

NUMBER = r"^\s*-?([0-9][0-9.eE+-]*|Infinity|NaN)\s*$"
#: Pieces of structure that a document may have, and numbers in lists that the driver looks at (shapes, edges).
PIECES = 200_000
SMALL = 1_000
MARK = "@"
#: Numbers of a part that is written.
PART = 1 << 20


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(pos, value, file, edge): the text between commas, in order.

    A file's last piece goes on in the next file's first one: both have one pos, and edge is true.
    """
    d = spark.read.option("lineSep", ",").text(path)
    d = d.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"))
    d = stage(d, "pieces")  # numbered once
    # a row for each range of bytes
    counts, by = d.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("i").alias("first")), Window.orderBy("file", "block")
    neighbour = lambda f: f("file").over(by)
    counts = counts.select(
        "file", "block", "n", "first",
        F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        (F.dense_rank().over(Window.orderBy("file")) - 1).alias("files"),
        (neighbour(F.lag) != F.col("file")).alias("opens"),
        (neighbour(F.lead) != F.col("file")).alias("ends"),
    )
    # a range is read by one task from end to end, so its numbers follow each other
    d = d.join(F.broadcast(counts), ["file", "block"]).withColumn("nth", F.col("i") - F.col("first") + 1)
    edge = (F.col("opens") & (F.col("nth") == 1)) | (F.col("ends") & (F.col("nth") == F.col("n")))
    return d.select((F.col("before") + F.col("nth") - 1 - F.col("files")).alias("pos"), "value", "file", F.coalesce(edge, F.lit(False)).alias("edge"))


@dataclass(frozen=True)
class Stretch:
    """Numbers at places start to end - 1 of the document."""

    start: int
    end: int


def unmarked(x):
    """The marks of a parsed skeleton as stretches."""
    if isinstance(x, list):
        return [unmarked(y) for y in x]
    if isinstance(x, dict):
        return {k: unmarked(y) for k, y in x.items()}
    if isinstance(x, str) and x.startswith(MARK):
        return Stretch(*map(int, x[1:].split(":")))
    return x


class Document:
    """A document's structure on the driver, with stretches in place of most numbers, and its numbers as a table (pos, v)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        try:
            d = stage(pieces(spark, path), "document")
        except AnalysisException as e:
            raise ValueError(f"{path} can't be read: {e}") from None
        is_number = F.col("value").rlike(NUMBER) & ~F.col("edge")
        found = d.where(~is_number).orderBy("pos", "file").limit(PIECES + 1).collect()
        if len(found) > PIECES:
            raise ValueError(f"{path} has more than {PIECES} pieces of structure")
        self.numbers = d.where(is_number).select("pos", F.trim("value", F.lit(" \t\r\n")).cast("double").alias("v"))
        last, text, at = d.agg(F.max("pos")).collect()[0][0], [], 0
        structure: dict[int, str] = {}
        for r in found:
            structure[r["pos"]] = structure.get(r["pos"], "") + r["value"]
        for here, value in [*structure.items(), (-1 if last is None else last + 1, "")]:
            if here > at:
                text.append(f'"{MARK}{at}:{here}"')
            if here in structure:
                text.append(value)
            at = here + 1
        try:
            self.doc = unmarked(json.loads(",".join(text)))
        except ValueError as e:
            raise ValueError(f"{path} isn't JSON: {e}") from None
        if not isinstance(self.doc, dict):
            raise ValueError(f"{path} doesn't hold a JSON object")

    def small(self, x) -> list:
        """A short list of numbers, its stretches filled in."""
        if not isinstance(x, list):
            raise ValueError(f"{self.path}: expected a list, not {x!r}")
        out = []
        for y in x:
            if isinstance(y, Stretch):
                if y.end - y.start > SMALL:
                    raise ValueError(f"{self.path}: a list of {y.end - y.start} numbers where a short one is expected")
                found = self.numbers.where(F.col("pos").between(y.start, y.end - 1)).orderBy("pos").collect()
                out += [int(r["v"]) if float(r["v"]).is_integer() else r["v"] for r in found]
            else:
                out.append(self.small(y) if isinstance(y, list) else y)
        return out

    def tensor(self, entry: dict, t: str, order: str) -> TensorRel:
        """The tensor of an entry with shape and data; all its cells."""
        shape, data = [int(n) for n in self.small(entry["shape"])], entry["data"]
        kind = dtype(t)
        per_cell = 2 if kind.is_complex else 1
        places, literals, n = [], [], 0  # (start, end, index of the first)
        for x in data:
            if isinstance(x, Stretch):
                places.append((x.start, x.end, n))
                n += x.end - x.start
            else:
                literals.append((n, float(x)))
                n += 1
        if n != per_cell * math.prod(shape):
            raise ValueError(f"data of length {n} doesn't match shape {shape} of {t}")
        parts = [self.numbers.where(F.col("pos").between(a, b - 1)).select((F.col("pos") - a + first).alias("i"), "v") for a, b, first in places]
        if literals or not parts:
            parts.append(self.spark.createDataFrame(literals, "i long, v double"))
        d = parts[0]
        for x in parts[1:]:
            d = d.unionAll(x)
        if kind.is_complex:
            part = lambda k: F.max(F.when(F.col("i") % 2 == k, F.col("v"))).cast(kind.part)
            d = d.groupBy(F.floor(F.col("i") / 2).alias("i")).agg(F.struct(part(0).alias("re"), part(1).alias("im")).alias("v"))
        coords = [coordinate(F.col("i"), s, k).alias(f"d{j}") for j, (s, k) in enumerate(zip(strides(shape, order), shape, strict=True))]
        return TensorRel(d.select(*coords, F.col("v").cast(kind.spark).alias("v")), shape, kind)


def numbers_of(t: TensorRel, order: str) -> DataFrame:
    """(lin, text): all cells in linear order, complex ones as two numbers."""
    d = t.to_dense()
    text = lambda v: v.cast("double").cast("string")
    v = F.concat(text(F.col("v.re")), F.lit(", "), text(F.col("v.im"))) if t.dtype.is_complex else text(F.col("v"))
    comma = F.when(F.col("lin") > 0, ",").otherwise("")
    return d.df.select(d.linear(order).alias("lin"), v.alias("v")).select("lin", F.concat(comma, "v").alias("text"))


def write(spark: SparkSession, path: str, content: Sequence[str | TensorRel], order: str) -> None:
    """A folder of parts: texts as they are, tensors as their numbers, one after the other."""
    out, cells = None, 0
    for k, x in enumerate(content):
        if isinstance(x, TensorRel):
            cells += x.numel
            d = numbers_of(x, order)
        else:
            d = spark.createDataFrame([(0, x)], "lin long, text string")
        d = d.select(F.lit(k).alias("k"), "lin", "text")
        out = d if out is None else out.unionAll(d)
    out = out.repartitionByRange(max(1, -(-cells // PART)), "k", "lin").sortWithinPartitions("k", "lin")
    out.select("text").write.text(path)


def head(t: str, order: str) -> str:
    return f'{{"dtype": {json.dumps(t)}, "order": {json.dumps(order)}'


def entry(t: TensorRel, first: str = "") -> list:
    """An object with shape and data as content."""
    return [f'{{{first}"shape": {json.dumps(list(t.shape))}, "data": [', t, "]}"]


def listed(entries: Sequence[list]) -> list:
    out: list = []
    for i, x in enumerate(entries):
        out += ([", "] if i else []) + x
    return out


def write_tensors(path: str, tensors: Sequence[TensorRel], order: str = "col_major") -> None:
    """A tensors document."""
    write(tensors[0].df.sparkSession, path, [head(tensors[0].dtype.name, order) + ', "tensors": [', *listed([entry(t) for t in tensors]), "]}"], order)


def write_result(path: str, t: TensorRel, order: str) -> None:
    """The document of a result, or of the gradient of one."""
    write(t.df.sparkSession, path, [head(t.dtype.name, order) + f', "shape": {json.dumps(list(t.shape))}, "data": [', t, "]}"], order)


def write_gradients(path: str, result: TensorRel, grads: Sequence[TensorRel], order: str) -> None:
    each = listed([entry(g, f'"input_index": {i}, ') for i, g in enumerate(grads)])
    write(result.df.sparkSession, path, [head(result.dtype.name, order) + ', "result": ', *entry(result), ', "gradients": [', *each, "]}"], order)
