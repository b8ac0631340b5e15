"""Tensors as coordinates: a DataFrame of index columns and a value, with a shape.

Index algebra (transpose, rotate, reshape, broadcast ...) is arithmetic on the
index columns, so several steps fold into one projection; only reductions along
an axis shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Selector = int | str | range | list[int]


@dataclass(frozen=True)
class Tensor:
    """df has columns i0 ... i<rank-1> (bigint) and v, one row per element."""

    df: DataFrame
    shape: tuple[int, ...]

    @property
    def rank(self) -> int:
        return len(self.shape)

    @property
    def axes(self) -> list[str]:
        return axes(self.rank)

    @property
    def strides(self) -> tuple[int, ...]:
        return strides(self.shape)

    def linear(self) -> Column:
        """The row-major position of each element."""
        return reduce(lambda a, b: a + b, (F.col(c) * s for c, s in zip(self.axes, self.strides, strict=True)), F.lit(0).cast("bigint"))


def axes(rank: int) -> list[str]:
    return [f"i{k}" for k in range(rank)]


def strides(shape: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(prod(shape[k + 1 :]) for k in range(len(shape)))


def _coords(at: Column, shape: tuple[int, ...]) -> list[Column]:
    return [F.call_function("div", at, F.lit(s)) % n for s, n in zip(strides(shape), shape, strict=True)]


def compute(spark: SparkSession, shape: tuple[int, ...], f: Callable[..., Column]) -> Tensor:
    """A tensor whose values are a function of the indexes."""
    ix = _coords(F.col("id"), shape)
    df = spark.range(prod(shape)).select(*(c.alias(n) for c, n in zip(ix, axes(len(shape)), strict=True)))
    return Tensor(df.withColumn("v", f(*map(F.col, axes(len(shape))))), shape)


def constant(spark: SparkSession, value: object, shape: tuple[int, ...]) -> Tensor:
    return compute(spark, shape, lambda *_: F.lit(value))


def zeros(spark: SparkSession, shape: tuple[int, ...]) -> Tensor:
    return constant(spark, 0.0, shape)


def from_vector(df: DataFrame, idx: str, v: str, shape: tuple[int, ...]) -> Tensor:
    """A vector in row-major order as a tensor."""
    ix = _coords(F.col(idx).cast("bigint"), shape)
    return Tensor(df.select(*(c.alias(n) for c, n in zip(ix, axes(len(shape)), strict=True)), F.col(v).alias("v")), shape)


def from_cells(df: DataFrame, row: str, cells: str, rows: int, width: int) -> Tensor:
    """Array cells of equal size, numbered by a row column, as a matrix."""
    return Tensor(df.select(F.col(row).cast("bigint").alias("i0"), F.posexplode(cells).alias("i1", "v")).withColumn("i1", F.col("i1").cast("bigint")), (rows, width))


def from_nested(spark: SparkSession, data: list) -> Tensor:
    """Nested lists, which must be regular."""
    shape: list[int] = []
    x = data
    while isinstance(x, list):
        shape.append(len(x))
        x = x[0] if x else None

    def walk(x: object, at: tuple[int, ...]) -> list[tuple]:
        if len(at) == len(shape):
            return [(*at, float(x))]
        if not isinstance(x, list) or len(x) != shape[len(at)]:
            raise ValueError("ragged data")
        return [r for k, y in enumerate(x) for r in walk(y, (*at, k))]

    form = ", ".join([f"{a} bigint" for a in axes(len(shape))] + ["v double"])
    return Tensor(spark.createDataFrame(walk(data, ()), form), tuple(shape))


def to_vector(t: Tensor) -> DataFrame:
    """idx, v in row-major order."""
    return t.df.select(t.linear().alias("idx"), "v")


def to_cells(t: Tensor) -> DataFrame:
    """The last axis as array cells."""
    last = t.axes[-1]
    pairs = F.sort_array(F.collect_list(F.struct(last, "v")))
    return t.df.groupBy(*t.axes[:-1]).agg(F.transform(pairs, lambda p: p["v"]).alias("v"))


def to_nested(t: Tensor) -> list:
    """Nested lists on the driver, for small tensors."""
    flat = [r["v"] for r in to_vector(t).orderBy("idx").collect()]
    for n in reversed(t.shape[1:]):
        flat = [flat[k : k + n] for k in range(0, len(flat), n)]
    return flat


def _moved(t: Tensor, columns: list[Column], shape: tuple[int, ...], where: Column | None = None) -> Tensor:
    df = t.df if where is None else t.df.where(where)
    return Tensor(df.select(*(c.cast("bigint").alias(n) for c, n in zip(columns, axes(len(shape)), strict=True)), "v"), shape)


def reshape(t: Tensor, shape: tuple[int, ...]) -> Tensor:
    """The same values in row-major order under another shape, which may hold fewer."""
    if prod(shape) > prod(t.shape):
        raise ValueError("a reshape can't hold more elements")
    at = t.linear()
    return _moved(t, _coords(at, shape), shape, at < prod(shape) if prod(shape) < prod(t.shape) else None)


def transpose(t: Tensor, order: list[int]) -> Tensor:
    if sorted(order) != list(range(t.rank)):
        raise ValueError("every axis exactly once")
    return _moved(t, [F.col(f"i{k}") for k in order], tuple(t.shape[k] for k in order))


def rotate(t: Tensor, by: list[int]) -> Tensor:
    """out[i] is in[(i + k) mod n] for each axis."""
    return _moved(t, [F.pmod(F.col(c) - k, F.lit(n)) for c, k, n in zip(t.axes, by, t.shape, strict=True)], t.shape)


def broadcast(t: Tensor, shape: tuple[int, ...]) -> Tensor:
    """Repeats along axes whose size divides the new one; missing axes are put in front."""
    lead = len(shape) - t.rank
    sizes = (1,) * lead + t.shape
    if any(n % m for n, m in zip(shape, sizes, strict=True)):
        raise ValueError("sizes must divide")
    df = t.df.select(*(F.lit(0).cast("bigint").alias(f"i{k}") for k in range(lead)), *(F.col(f"i{k}").alias(f"i{k + lead}") for k in range(t.rank)), "v")
    for k, (n, m) in enumerate(zip(shape, sizes, strict=True)):
        if n > m:
            df = df.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(n // m - 1)))).withColumn(f"i{k}", F.col(f"i{k}") + F.col("_r") * m).drop("_r")
    return Tensor(df.select(*axes(len(shape)), "v"), shape)


def select(t: Tensor, *by: Selector) -> Tensor:
    """Per axis: "all", "reverse", a number (drops the axis), a range or a list of indexes (repeats allowed)."""
    df, shape, kept = t.df, [], []
    for k, (s, n) in enumerate(zip((*by, *["all"] * (t.rank - len(by))), t.shape, strict=True)):
        c = f"i{k}"
        if s == "all":
            kept.append(F.col(c))
            shape.append(n)
        elif s == "reverse":
            kept.append(n - 1 - F.col(c))
            shape.append(n)
        elif isinstance(s, int):
            df = df.where(F.col(c) == (s if s >= 0 else n + s))
        elif isinstance(s, range) and s.step == 1:
            df = df.where(F.col(c).between(s.start, s.stop - 1))
            kept.append(F.col(c) - s.start)
            shape.append(len(s))
        else:
            to: dict[int, list[int]] = {}
            for out, i in enumerate(s):
                to.setdefault(i, []).append(out)
            place = F.create_map(*(x for i, outs in to.items() for x in (F.lit(i).cast("bigint"), F.array(*map(F.lit, outs)))))
            df = df.where(F.col(c).isin(*to)).withColumn(f"_o{k}", F.explode(place[F.col(c)]))
            kept.append(F.col(f"_o{k}"))
            shape.append(len(s))
    return _moved(Tensor(df, t.shape), kept, tuple(shape))


def slices(t: Tensor, n: int) -> DataFrame:
    """All sub-tensors under the first n axes: slice (the row-major number of a sub-tensor), its own axes and v, in one DataFrame."""
    at = reduce(lambda a, b: a + b, (F.col(c) * s for c, s in zip(t.axes[:n], strides(t.shape[:n]), strict=True)), F.lit(0).cast("bigint"))
    return t.df.select(at.alias("slice"), *(F.col(c).alias(f"i{k}") for k, c in enumerate(t.axes[n:])), "v")


def slices_right(t: Tensor, n: int) -> DataFrame:
    """All sub-tensors under the last n axes, as slices() has them."""
    return slices(transpose(t, [*range(t.rank - n, t.rank), *range(t.rank - n)]), n)


def at(t: Tensor, *by: int) -> Tensor:
    """The sub-tensor under the first axes at some indexes."""
    return select(t, *by)


def at_right(t: Tensor, *by: int) -> Tensor:
    """The sub-tensor under the last axes at some indexes."""
    return select(t, *["all"] * (t.rank - len(by)), *by)


def rows(t: Tensor) -> DataFrame:
    """i0 and its sub-tensor as an array in row-major order."""
    inner = F.sort_array(F.collect_list(F.struct(*t.axes[1:], "v")))
    return t.df.groupBy("i0").agg(F.transform(inner, lambda p: p["v"]).alias("v"))


def columns(t: Tensor) -> DataFrame:
    last = t.axes[-1]
    inner = F.sort_array(F.collect_list(F.struct(*t.axes[:-1], "v")))
    return t.df.groupBy(last).agg(F.transform(inner, lambda p: p["v"]).alias("v"))


def mget(t: Tensor, *at: int) -> Tensor:
    return select(t, *at)


def mset(t: Tensor, value: Column | float, where: Column) -> Tensor:
    """Sets the elements at which a condition on the indexes holds."""
    v = value if isinstance(value, Column) else F.lit(value)
    return Tensor(t.df.withColumn("v", F.when(where, v).otherwise(F.col("v"))), t.shape)


def assign(t: Tensor, updates: DataFrame) -> Tensor:
    """Overwrites with rows (axes, v)."""
    new = updates.select(*t.axes, F.col("v").alias("_new"), F.lit(True).alias("_set"))
    return Tensor(t.df.join(new, t.axes, "left").select(*t.axes, F.when(F.col("_set"), F.col("_new")).otherwise(F.col("v")).alias("v")), t.shape)


def assign_at(t: Tensor, part: Tensor, place: tuple[int, ...]) -> Tensor:
    """Overwrites a block of the same rank that begins at a place and lies inside."""
    if any(o < 0 or o + m > n for o, m, n in zip(place, part.shape, t.shape, strict=True)):
        raise ValueError("the block must lie inside")
    return assign(t, part.df.select(*((F.col(c) + o).alias(c) for c, o in zip(t.axes, place, strict=True)), "v"))


def zip_with(a: Tensor, b: Tensor, f: Callable[[Column, Column], Column]) -> Tensor:
    """Elementwise over two tensors; the smaller is broadcast."""
    shape = tuple(max(x, y) for x, y in zip((1,) * (b.rank - a.rank) + a.shape, (1,) * (a.rank - b.rank) + b.shape, strict=True))
    a, b = (x if x.shape == shape else broadcast(x, shape) for x in (a, b))
    both = a.df.withColumnRenamed("v", "_a").join(b.df.withColumnRenamed("v", "_b"), a.axes)
    return Tensor(both.select(*a.axes, f(F.col("_a"), F.col("_b")).alias("v")), shape)


def emap(t: Tensor, f: Callable[[Column], Column]) -> Tensor:
    return Tensor(t.df.withColumn("v", f(F.col("v"))), t.shape)


def reduce_axis(t: Tensor, agg: Callable[[Column], Column] = F.sum, axis: int = -1) -> Tensor:
    """An aggregate along an axis, which goes."""
    axis %= t.rank
    rest = [c for k, c in enumerate(t.axes) if k != axis]
    df = t.df.groupBy(*rest).agg(agg(F.col("v")).alias("v"))
    return Tensor(df.select(*(F.col(c).alias(n) for c, n in zip(rest, axes(len(rest)), strict=True)), "v"), tuple(n for k, n in enumerate(t.shape) if k != axis))


def map_axis(t: Tensor, f: Callable[[object], Column], axis: int = -1) -> Tensor:
    """A window function along an axis; f gets the window."""
    axis %= t.rank
    w = Window.partitionBy(*(c for k, c in enumerate(t.axes) if k != axis)).orderBy(f"i{axis}")
    return Tensor(t.df.withColumn("v", f(w)), t.shape)


def map_vectors(t: Tensor, f: Callable[[Column], Column], axis: int = -1) -> Tensor:
    """A function of each whole vector along an axis, an array of doubles to one of the same length."""
    axis %= t.rank
    rest = [c for k, c in enumerate(t.axes) if k != axis]
    held = t.df.groupBy(*rest).agg(F.sort_array(F.collect_list(F.struct(f"i{axis}", "v"))).alias("_a"))
    out = held.select(*rest, F.posexplode(f(F.transform("_a", lambda p: p["v"]))).alias(f"i{axis}", "v"))
    return Tensor(out.select(*(F.col(c).cast("bigint").alias(c) for c in t.axes), "v"), t.shape)


def to_strings(t: Tensor, n: int) -> DataFrame:
    """The sub-tensors under the first n axes as nested brackets in row-major order: those axes and v."""
    df = t.df.withColumn("v", F.col("v").cast("string"))
    for k in range(t.rank - 1, n - 1, -1):
        inner = F.transform(F.sort_array(F.collect_list(F.struct(f"i{k}", "v"))), lambda p: p["v"])
        df = df.groupBy(*t.axes[:k]).agg(F.concat(F.lit("["), F.array_join(inner, " "), F.lit("]")).alias("v"))
    return df


def matmul(a: Tensor, b: Tensor, block: int = 256) -> Tensor:
    """The product of two matrices, in square blocks: a shuffle row is a block, and a task multiplies pairs of them."""
    m = -(-a.shape[1] // block)
    pack = F.collect_list(F.struct((F.col("i0") % block).cast("int").alias("r"), (F.col("i1") % block).cast("int").alias("c"), F.col("v").cast("double").alias("v")))  # block^2 cells at most

    def packed(t: Tensor, names: tuple[str, str, str]) -> DataFrame:
        place = (F.floor(F.col("i0") / block).alias(names[0]), F.floor(F.col("i1") / block).alias(names[1]))
        return t.df.groupBy(*place).agg(pack.alias(names[2]))

    pairs = packed(a, ("i", "k", "x")).join(packed(b, ("k", "j", "y")), "k")

    def dense(cells: pa.ListScalar) -> np.ndarray:
        out, c = np.zeros((block, block)), cells.values
        out[c.field("r").to_numpy(), c.field("c").to_numpy()] = c.field("v").to_numpy(zero_copy_only=False)
        return out

    height, width = a.shape[0], b.shape[1]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, x, y in zip(*batch.columns, strict=True):
                z = dense(x) @ dense(y)
                r, c = np.nonzero(np.ones_like(z))
                r, c = r + i.as_py() * block, c + j.as_py() * block
                on = (r < height) & (c < width)
                yield pa.RecordBatch.from_arrays([pa.array(r[on]), pa.array(c[on]), pa.array(z.ravel()[on])], ["i0", "i1", "v"])

    parts = pairs.select("i", "j", "x", "y").mapInArrow(multiply, "i0 bigint, i1 bigint, v double")
    return Tensor(parts.groupBy("i0", "i1").agg(F.sum("v").alias("v")) if m > 1 else parts, (height, width))


def is_dense(t: Tensor) -> bool:
    """Whether every element has its row."""
    return t.df.count() == prod(t.shape)
