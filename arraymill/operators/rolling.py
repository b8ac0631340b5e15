"""Windows, cumulative operations, gradients and resampling of ordered vectors.

Vectors are told apart by keys and ordered by one column, so every operation is
a window partitioned by the keys. One vector without keys (keys=[]) is worked on
in range partitions: operations of a bounded reach in blocks with the rows
within reach (prefix.in_blocks), running ones by a scan (prefix.scan).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from arraymill.operators.prefix import in_blocks, positions_within, row_numbers, scan, scan_within, tree_sums
from arraymill.store import fixed as stored

NAN = float("nan")


def window(keys: list[str], order: str | list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*([order] if isinstance(order, str) else order))


def offsets(size: int, position: str = "center") -> tuple[int, int]:
    """First and last row of a window around its row: left trails, right leads."""
    if position == "left":
        return -(size - 1), 0
    return (0, size - 1) if position == "right" else (-(size // 2), size - 1 - size // 2)


def padded(x: str, w: WindowSpec, size: int, position: str = "center", edge: str = "clamp") -> Column:
    """The window as an array of fixed size: end values repeat (clamp) or zeros stand in (zero)."""
    lo, hi = offsets(size, position)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n, at = F.count(F.lit(1)).over(whole), F.row_number().over(w) - 1
    first, last = (F.first(x).over(whole), F.last(x).over(whole)) if edge == "clamp" else (F.lit(0), F.lit(0))
    inner = F.collect_list(x).over(w.rowsBetween(lo, hi))
    left = F.least(F.greatest(-(at + lo), F.lit(0)), F.lit(size)).cast("int")
    right = F.least(F.greatest(at + hi - (n - 1), F.lit(0)), F.lit(size)).cast("int")
    return F.concat(F.array_repeat(first, left), inner, F.array_repeat(last, right))


#: Window functions with a frame form that needs no array.
_FRAMES = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}


def fixed(df: DataFrame, x: str, keys: list[str], order: str, size: int, f: str | Callable[[Column], Column] = "mean", position: str = "center", edge: str = "clamp", name: str = "rolled") -> DataFrame:
    """f over a window of fixed size around each row; the window is padded at the ends.

    f: sum, mean, min or max (frames with a correction for the padding), or a
    function from the padded array to a column.
    """
    if not keys:
        lo, hi = offsets(size, position)
        return in_blocks(df, [order], lambda d, k: fixed(d, x, k, order, size, f, position, edge, name), -lo, hi)
    w = window(keys, order)
    if callable(f):
        return df.withColumn(name, f(padded(x, w, size, position, edge)))
    lo, hi = offsets(size, position)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n, at = F.count(F.lit(1)).over(whole), F.row_number().over(w) - 1
    left, right = F.greatest(-(at + lo), F.lit(0)), F.greatest(at + hi - (n - 1), F.lit(0))
    frame = w.rowsBetween(lo, hi)
    if f in ("min", "max"):  # end values are inside every clamped window that reaches past them
        inner = _FRAMES[f](x).over(frame)
        both = F.least if f == "min" else F.greatest
        return df.withColumn(name, inner if edge == "clamp" else F.when(left + right > 0, both(inner, F.lit(0))).otherwise(inner))
    ends = left * F.first(x).over(whole) + right * F.last(x).over(whole) if edge == "clamp" else F.lit(0)
    total = F.sum(x).over(frame) + ends
    return df.withColumn(name, total if f == "sum" else total / size)


def ranges(df: DataFrame, keys: list[str], order: str, size: int, position: str = "center") -> DataFrame:
    """Adds first and past: the clamped positions that each row's window covers."""
    lo, hi = offsets(size, position)
    if keys:
        w = window(keys, order)
        n, at = F.count(F.lit(1)).over(Window.partitionBy(*keys)), F.row_number().over(w) - 1
    else:
        n, at, columns = F.lit(df.count()), F.col("__i"), df.columns
        df = row_numbers(df, [order], "__i")
        return df.withColumn("first", F.greatest(at + lo, F.lit(0)).cast("bigint")).withColumn("past", F.least(at + hi + 1, n).cast("bigint")).select(*columns, "first", "past")
    return df.withColumn("first", F.greatest(at + lo, F.lit(0)).cast("bigint")).withColumn("past", F.least(at + hi + 1, n).cast("bigint"))


def variable(df: DataFrame, keys: list[str], order: Column, span: float, aggs: dict[str, Callable[[], Column] | str], position: str = "right") -> DataFrame:
    """Aggregates over the rows less than span away in the order's value: after (right), before (left) or half each (center).

    The order may be whole numbers or doubles; for doubles the aggregates are
    SQL, as in {"n": "count(*)"}. Windows include their own row and, as bounds
    are strict, no row that is span away; centred ones reach from half a span
    before (included) to half a span after.
    """
    kind = df.select(order.alias("v")).schema["v"].dataType.typeName()
    w = Window.partitionBy(*keys).orderBy(order)
    if kind in ("byte", "short", "integer", "long") and float(span).is_integer():
        span = int(span)
        lo, hi = {"right": (0, span - 1), "left": (-(span - 1), 0), "center": (-(span // 2), span - 1 - span // 2)}[position]
        frame = w.rangeBetween(lo, hi)
        return df.select("*", *((F.expr(f) if isinstance(f, str) else f()).over(frame).alias(n) for n, f in aggs.items()))
    inside = math.nextafter(float(span), 0.0), math.nextafter(span / 2, 0.0)
    lo, hi = {"right": (0.0, inside[0]), "left": (inside[0], 0.0), "center": (span / 2, inside[1])}[position]
    by = ", ".join(f"`{k}`" for k in keys) or "1"
    frame = f"OVER (PARTITION BY {by} ORDER BY __order RANGE BETWEEN {lo!r}D PRECEDING AND {hi!r}D FOLLOWING)"
    held = df.withColumn("__order", order.cast("double"))
    return held.select(*df.columns, *(F.expr(f"{f} {frame}").alias(n) for n, f in aggs.items()))


def variable_steps(df: DataFrame, keys: list[str], order: str, span: float, step: float, aggs: dict[str, Column], unit: str | None = None) -> DataFrame:
    """keys, first, past and aggregates: a window from a row up to span (excluded) after it, then one from the first row at least step later, and so on.

    first and past are positions in the vector. With unit (seconds to years)
    the order is a timestamp, and span and step count whole units by the
    calendar. The walk from window to window is by position alone: a join of
    each row with the row that its step leads to, doubled until no walk is
    longer, so that windows are found in rounds that grow with the logarithm of
    their count.
    """
    own = keys or ["__one"]
    rows = df if keys else df.withColumn("__one", F.lit(0))
    rows = stored(positions_within(rows, own, [order], "__i"))
    value = F.col(order) if unit else F.col(order).cast("double")

    def reach(n: float, name: str) -> DataFrame:
        """own, __i, name: the position of the first row that is n or more after each row (the count if none)."""
        far = F.timestamp_add(unit[:-1].upper(), F.lit(int(n)), value.cast("timestamp")) if unit else value + F.lit(float(n))
        marks = rows.select(*own, far.alias("__at"), F.lit(0).alias("__side"), F.col("__i"))
        data = rows.select(*own, (value.cast("timestamp") if unit else value).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast("bigint").alias("__i"))
        both = scan_within(marks.union(data), own, ["__at", "__side", "__i"], F.col("__side").cast("bigint"), name)
        return both.where("__side = 0").select(*own, "__i", name)

    ends = reach(span, "__past")
    if step:
        jump = stored(reach(step, "__to").select(*own, "__i", F.greatest(F.col("__to"), F.col("__i") + 1).alias("__to")))
        seen = stored(rows.where("__i = 0").select(*own, "__i"))
        while True:  # seen: the starts up to 2^k steps; jump: where 2^k steps lead
            more = seen.join(jump, [*own, "__i"]).select(*own, F.col("__to").alias("__i")).join(rows.select(*own, "__i"), [*own, "__i"], "left_semi")
            more = stored(more)
            if not more.limit(1).count():
                break
            seen = stored(seen.union(more))
            jump = stored(jump.join(jump.select(*own, F.col("__i").alias("__to"), F.col("__to").alias("__t2")), [*own, "__to"]).select(*own, "__i", F.col("__t2").alias("__to")))
        ends = ends.join(seen, [*own, "__i"])
    spans = ends.select(*own, F.col("__i").alias("first"), F.col("__past").alias("past"))
    covered = spans.withColumn("__i", F.explode(F.sequence("first", F.col("past") - 1)))
    out = covered.join(rows, [*own, "__i"]).groupBy(*own, "first", "past").agg(*(a.alias(n) for n, a in aggs.items()))
    return out.select(*keys, "first", "past", *aggs)


def expanding(df: DataFrame, keys: list[str], order: str, aggs: dict[str, Column]) -> DataFrame:
    """Aggregates over all rows up to each row."""
    w = window(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.select("*", *(a.over(w).alias(n) for n, a in aggs.items()))


def _cumulative(agg: Callable[[Column], Column]) -> Callable[..., DataFrame]:
    def run(df: DataFrame, x: str, keys: list[str], order: str, name: str = "run") -> DataFrame:
        v = F.col(x).cast("double")
        if not keys:
            got = scan(df, [order], F.when(~F.isnan(v), v), name, agg.__name__)
            return got.withColumn(name, F.when(F.isnan(v), F.lit(NAN)).otherwise(F.col(name)))
        w = window(keys, order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.when(F.isnan(v), F.lit(NAN)).otherwise(agg(F.when(~F.isnan(v), v)).over(w)))

    return run


#: Running sum, minimum and maximum; a NaN row gives NaN and is passed over.
cumsum, cummin, cummax = _cumulative(F.sum), _cumulative(F.min), _cumulative(F.max)


#: The largest number with a finite exponential.
_LARGEST = 709.782712893384


@pandas_udf(DoubleType())
def _log(x: pd.Series) -> pd.Series:
    return pd.Series([math.log(v) for v in x.tolist()], dtype=float)


@pandas_udf(DoubleType())
def _exp(x: pd.Series) -> pd.Series:
    return pd.Series([math.inf if v > _LARGEST else math.exp(v) for v in x.tolist()], dtype=float)


def cumprod(df: DataFrame, x: str, keys: list[str], order: str, name: str = "run") -> DataFrame:
    """The running product, by signs, zeros and sums of logarithms; a NaN row gives NaN and is passed over.

    Without keys the sum is a long one, which the exponential would magnify the
    errors of: it is added in a tree, of logarithms from the C library, whose
    last bits Java's differ from.
    """
    v = F.col(x).cast("double")
    ok = F.when(~F.isnan(v), v)
    zero, below = (ok == 0).cast("bigint"), (ok < 0).cast("bigint")
    if not keys:
        got = tree_sums(df, [order], {"__n": ok.isNotNull(), "__z": zero, "__m": below, "__s": _log(F.when(ok != 0, F.abs(ok)))})
        got = got.withColumn("__s", _exp("__s"))
        value = F.when(F.col("__z") > 0, F.lit(0.0)).otherwise(F.when(F.col("__m") % 2 == 1, -F.col("__s")).otherwise(F.col("__s")))
        return got.withColumn(name, F.when(F.isnan(v), F.lit(NAN)).when(F.col("__n") > 0, value)).select(*df.columns, name)
    log = F.when(ok != 0, F.ln(F.abs(ok)))
    w = window(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    zeros, minus, size = F.sum(zero).over(w), F.sum(below).over(w), F.exp(F.sum(log).over(w))
    value = F.when(zeros > 0, F.lit(0.0)).otherwise(F.when(minus % 2 == 1, -size).otherwise(size))
    return df.withColumn(name, F.when(F.isnan(v), F.lit(NAN)).otherwise(value))


def shift(df: DataFrame, x: str, keys: list[str], order: str, n: int, name: str = "shifted") -> DataFrame:
    """The value n rows back (forward if negative); end values repeat."""
    if not keys:
        return in_blocks(df, [order], lambda d, k: shift(d, x, k, order, n, name), max(n, 0), max(-n, 0))
    w = window(keys, order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at, count = F.row_number().over(w), F.count(F.lit(1)).over(whole)
    if n >= 0:
        return df.withColumn(name, F.when(at <= n, F.first(x).over(whole)).otherwise(F.lag(x, n).over(w)))
    return df.withColumn(name, F.when(at > count + n, F.last(x).over(whole)).otherwise(F.lead(x, -n).over(w)))


def fill_range(df: DataFrame, x: str, keys: list[str], span: float) -> DataFrame:
    """keys, x, inserted: values in order, with points put evenly between any two that are more than span apart."""
    after = lambda d, k: d.withColumn("_next", F.lead(x).over(window(k, x)))
    gap = (after(df, keys) if keys else in_blocks(df.select(x), [x], after, ahead=1)).select(*keys, x, "_next")
    parts = F.when(F.col("_next") - F.col(x) > span, F.ceil((F.col("_next") - F.col(x)) / span)).otherwise(1).cast("int")
    rows = gap.withColumn("_parts", parts).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    value = F.col(x) + F.when(F.col("_k") == 0, 0.0).otherwise((F.col("_next") - F.col(x)) * F.col("_k") / F.col("_parts"))
    return rows.select(*keys, value.alias(x), (F.col("_k") > 0).alias("inserted"))


def gradient1d(df: DataFrame, x: str, keys: list[str], order: str, dx: float = 1.0, name: str = "gradient") -> DataFrame:
    """Central differences, one-sided at the ends; of one value 0."""
    if not keys:
        return in_blocks(df, [order], lambda d, k: gradient1d(d, x, k, order, dx, name), 1, 1)
    w = window(keys, order)
    before, after, own = F.lag(x).over(w), F.lead(x).over(w), F.col(x)
    width = F.when(before.isNotNull() & after.isNotNull(), 2.0).otherwise(1.0)
    return df.withColumn(name, (F.coalesce(after, own) - F.coalesce(before, own)) / (width * dx))


def diff1d(df: DataFrame, x: str, keys: list[str], order: str, prepend: float | None = None, append: float | None = None, name: str = "diff") -> DataFrame:
    """Differences to the row before (after, if append is given); without either the first row goes."""
    if not keys:
        return in_blocks(df, [order], lambda d, k: diff1d(d, x, k, order, prepend, append, name), 1, 1)
    w = window(keys, order)
    if append is not None:
        return df.withColumn(name, F.coalesce(F.lead(x).over(w), F.lit(append)) - F.col(x))
    if prepend is not None:
        return df.withColumn(name, F.col(x) - F.coalesce(F.lag(x).over(w), F.lit(prepend)))
    return df.withColumn(name, F.col(x) - F.lag(x).over(w)).withColumn("_r", F.row_number().over(w)).where("_r > 1").drop("_r")


def _placed(df: DataFrame, x: str, keys: list[str], order: str) -> DataFrame:
    """keys, x, _i, _n: positions and counts."""
    if not keys:
        return row_numbers(df.select(order, x), [order], "_i").select(x, "_i", F.lit(df.count()).alias("_n"))
    return df.select(*keys, F.col(x), (F.row_number().over(window(keys, order)) - 1).cast("bigint").alias("_i"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_n"))


def downsample(df: DataFrame, x: str, keys: list[str], order: str, n: int) -> DataFrame:
    """keys, pos, x: the values nearest to n evenly spread positions of each vector, or all of a shorter one."""
    placed = _placed(df, x, keys, order)
    size = F.least(F.lit(n), F.col("_n"))
    to = F.floor(F.lit(0.5) + F.col("pos") * (F.col("_n") - 1) / F.greatest(size - 1, F.lit(1)))
    want = placed.select(*keys, "_n").distinct().withColumn("pos", F.explode(F.sequence(F.lit(0).cast("bigint"), size - 1))).withColumn("_i", to.cast("bigint"))
    return want.join(placed.drop("_n"), [*keys, "_i"]).select(*keys, F.col("pos").alias("pos"), x)


def downsample_blocks(df: DataFrame, x: str, keys: list[str], order: str, n: int, agg: Callable[[Column], Column] = F.avg) -> DataFrame:
    """keys, pos, x: n blocks of each vector (of a shorter one as many as it has values), reduced by an aggregate.

    A block begins at its number times count / n, rounded, and holds count / n
    values, rounded: neighbours can share a value or leave one out.
    """
    placed = _placed(df, x, keys, order)
    size = F.least(F.lit(n), F.col("_n"))
    wide = F.col("_n") / size
    half = lambda c: F.floor(c + 0.5).cast("bigint")
    about = F.floor(F.col("_i") / wide).cast("bigint")
    spread = placed.withColumn("pos", F.explode(F.sequence(F.greatest(about - 1, F.lit(0)), F.least(about + 1, size - 1))))
    inside = (F.col("_i") >= half(F.col("pos") * wide)) & (F.col("_i") < half(F.col("pos") * wide) + half(wide))
    return spread.where(inside).groupBy(*keys, "pos").agg(agg(F.col(x)).alias(x))
