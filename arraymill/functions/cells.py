"""Short vectors in one cell: operations on array columns by higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from arraymill.functions.expr import divide

Binary = Callable[[Column, Column], Column]


def _doubles(a: Column) -> Column:
    return a.cast("array<double>")


def elementwise(f: Callable[[Column], Column], a: Column) -> Column:
    return F.transform(a, f)


def zipped(f: Binary, a: Column, b: Column) -> Column:
    """f over two arrays, as long as the shorter."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), f)


def fold(a: Column, start: Column, f: Binary) -> Column:
    return F.aggregate(a, start, f)


def total(a: Column) -> Column:
    return F.aggregate(_doubles(a), F.lit(0.0), lambda s, x: s + F.when(F.isnan(x), 0.0).otherwise(x))


def product(a: Column) -> Column:
    return F.aggregate(_doubles(a), F.lit(1.0), lambda s, x: s * x)


def mean(a: Column) -> Column:
    return divide(total(a), F.size(F.filter(_doubles(a), lambda x: ~F.isnan(x))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def magnitude_squared(a: Column) -> Column:
    return F.aggregate(_doubles(a), F.lit(0.0), lambda s, x: s + x * x)


def magnitude(a: Column) -> Column:
    return F.sqrt(magnitude_squared(a))


def distance_squared(a: Column, b: Column) -> Column:
    d = F.zip_with(_doubles(a), _doubles(b), lambda x, y: F.when(F.isnan(x) & F.isnan(y), 0.0).otherwise((x - y) * (x - y)))
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(distance_squared(a, b))


def normalize(a: Column) -> Column:
    m = magnitude(a)
    return F.transform(_doubles(a), lambda x: divide(x, m))


def get(a: Column, i: int | Column) -> Column:
    """The element at a position from 0; negative ones count from the end."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.get(a, F.when(i < 0, F.size(a) + i).otherwise(i).cast("int"))


def set_value(a: Column, i: int, v: Column) -> Column:
    return F.transform(a, lambda x, k: F.when(k == i, v).otherwise(x))


def set_constant(a: Column, offset: int, length: int, v: Column) -> Column:
    return F.transform(a, lambda x, k: F.when((k >= offset) & (k < offset + length), v).otherwise(x))


def sub(a: Column, offset: int, length: int) -> Column:
    return F.slice(a, offset + 1, length)


def gather(a: Column, indexes: list[int] | Column) -> Column:
    ix = F.array(*map(F.lit, indexes)) if isinstance(indexes, list) else indexes
    return F.transform(ix, lambda i: F.get(a, i))


def concat(*arrays: Column) -> Column:
    return F.concat(*arrays)


def reverse(a: Column) -> Column:
    return F.reverse(a)


def flatten(a: Column) -> Column:
    return F.flatten(a)


def argsort(a: Column) -> Column:
    """Positions in the order of the values, equal ones in their own order."""
    s = F.array_sort(F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    return F.transform(s, lambda p: p["i"])


def argmin(a: Column) -> Column:
    return F.array_min(F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))["i"]


def argmax(a: Column) -> Column:
    return -F.array_max(F.transform(a, lambda x, i: F.struct(x.alias("x"), (-i).alias("i"))))["i"]


def argfilter(a: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(F.filter(F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda p: f(p["x"])), lambda p: p["i"])


def index_of(a: Column, v: Column) -> Column:
    at = F.array_position(a, v)
    return F.when(at > 0, at - 1).otherwise(F.size(a))


def cumsum(a: Column) -> Column:
    """Running sums of a short array."""
    more = lambda s, x: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0.0)) + x))
    return F.aggregate(_doubles(a), F.array().cast("array<double>"), more)
