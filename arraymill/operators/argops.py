"""Index-space operations: sorting, grouping, searching and filtering by position.

A vector is a DataFrame with an index column and a value column, and keys where
there are several vectors. Results are positions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arraymill.functions.expr import predicate
from arraymill.operators.prefix import in_blocks, positions_within, row_numbers, scan


def sort_keys(x: str, descending: bool = False, nan: str = "last") -> list[Column]:
    """The order of values with NaN (and null) first or last, or failing on them."""
    c = F.col(x)
    hole = c.isNull() | F.isnan(c.cast("double"))
    if nan == "exception":
        c = F.when(hole, F.raise_error(F.lit("NaN in the data")).cast("double")).otherwise(c)
        return [c.desc() if descending else c.asc()]
    rank = F.when(hole, F.lit(0 if nan == "first" else 2)).otherwise(1)
    return [rank.asc(), c.desc() if descending else c.asc()]


def argsort(df: DataFrame, x: str, idx: str, keys: list[str] | None = None, descending: bool = False, nan: str = "last") -> DataFrame:
    """keys, pos, idx: the index of the value at each sorted position; equal values in index order."""
    order = [*sort_keys(x, descending, nan), F.col(idx).asc()]
    if keys:
        pos = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
        return df.select(*keys, pos.cast("bigint").alias("pos"), idx)
    marked = df.select(idx, x).withColumn("_r", F.when(F.col(x).isNull() | F.isnan(F.col(x).cast("double")), F.lit(0 if nan == "first" else 2)).otherwise(1))
    value = F.col(x).desc() if descending else F.col(x).asc()
    return row_numbers(marked, [F.col("_r").asc(), value, F.col(idx).asc()], "pos").select("pos", idx)


def arg_min_n(df: DataFrame, n: int, x: str, idx: str, descending: bool = False) -> DataFrame:
    """The indexes of the n smallest values (largest if descending)."""
    return df.orderBy(*sort_keys(x, descending), F.col(idx).asc()).limit(n).select(idx, x)


def argmin(x: Column, idx: Column) -> Column:
    """The first index of the smallest value that is not NaN."""
    ok = F.when(~F.isnan(x.cast("double")), F.struct(x.alias("v"), idx.alias("i")))
    return F.min(ok)["i"]


def argmax(x: Column, idx: Column) -> Column:
    """The first index of the largest value that is not NaN."""
    ok = F.when(~F.isnan(x.cast("double")), F.struct(x.alias("v"), (-idx).alias("i")))
    return -F.max(ok)["i"]


def arglast_every(df: DataFrame, x: str, idx: str, keys: list[str] | None = None, op: str = "gt") -> DataFrame:
    """The index that a running comparison settles on: later values win where they compare true with the best so far."""
    strict, up = op in ("gt", "lt"), op in ("gt", "gte")
    pick = F.max(F.struct(F.col(x) if up else -F.col(x), (-F.col(idx)) if strict else F.col(idx)))
    got = df.groupBy(*(keys or [])).agg(pick.alias("_p"))
    second = F.col("_p")["col2"]
    return got.select(*(keys or []), (-second if strict else second).alias("idx"))


def index_of(cond: Column, idx: Column, n: Column | int) -> Column:
    """The first index where cond holds, else n."""
    return F.coalesce(F.min(F.when(cond, idx)), n if isinstance(n, Column) else F.lit(n)).cast("bigint")


def last_index_of(cond: Column, idx: Column) -> Column:
    """The last index where cond holds, else -1."""
    return F.coalesce(F.max(F.when(cond, idx)), F.lit(-1)).cast("bigint")


def binary_search(x: Column, target: Column) -> Column:
    """The lower-bound position of a target in sorted data, as an aggregate over the data."""
    return F.count(F.when(x < target, 1)).cast("bigint")


def search_many(data: DataFrame, x: str, targets: DataFrame, t: str) -> DataFrame:
    """targets with pos, the lower-bound position of each in the sorted data: distinct values of both are merged in one ordered scan."""
    counts = data.groupBy(F.col(x).alias("_v")).agg(F.count("*").alias("_n"), F.lit(1).alias("_of"))
    asked = targets.select(F.col(t).alias("_v")).distinct().select("_v", F.lit(0).cast("bigint").alias("_n"), F.lit(0).alias("_of"))
    done = scan(counts.unionByName(asked), ["_v", "_of"], F.col("_n"), "pos")
    found = done.where("_of = 0").select(F.col("_v").alias(t), "pos")
    return targets.join(found, t)


def argfilter(df: DataFrame, pred: str | Callable[[Column], Column], x: str, idx: str, keys: list[str] | None = None) -> DataFrame:
    """The indexes whose value satisfies a predicate."""
    return df.where(predicate(pred)(F.col(x))).select(*(keys or []), idx)


def binary_argfilter(left: DataFrame, right: DataFrame, pred: str | Callable[[Column, Column], Column], x: str, idx: str) -> DataFrame:
    """The indexes at which the values of two vectors satisfy a predicate."""
    both = left.select(idx, F.col(x).alias("_a")).join(right.select(idx, F.col(x).alias("_b")), idx)
    return both.where(predicate(pred)(F.col("_a"), F.col("_b"))).select(idx)


def indexes_where(df: DataFrame, flag: str, idx: str) -> DataFrame:
    """The indexes at which a boolean vector is true."""
    return df.where(F.col(flag)).select(idx)


def arggroup(df: DataFrame, by: str | Column, idx: str, keys: list[str] | None = None, name: str = "key") -> DataFrame:
    """name, first, indexes: for each value its indexes in order, in one array; first tells the order in which values were met. See arggroup_rows for values of any count."""
    by = F.col(by) if isinstance(by, str) else by
    out = df.groupBy(*(keys or []), by.alias(name))
    return out.agg(F.min(idx).alias("first"), F.sort_array(F.collect_list(idx)).alias("indexes"))


def arggroup_rows(df: DataFrame, by: str | Column, idx: str, name: str = "key") -> DataFrame:
    """name, pos, idx: the indexes of each value as rows numbered in order; a value may have more than a task holds."""
    by = F.col(by) if isinstance(by, str) else by
    return positions_within(df.select(by.alias(name), idx), [name], [idx]).select(name, "pos", idx)


def argpartition(df: DataFrame, by: str | Column, idx: str, keys: list[str]) -> DataFrame:
    """keys, run, first, last, n, value: runs of equal values in index order, all runs included; without keys those of one vector, in range partitions."""
    by = F.col(by) if isinstance(by, str) else by
    if not keys:
        fresh = lambda d, k: d.withColumn("_new", (~F.col("_b").eqNullSafe(F.lag("_b").over(Window.partitionBy(*k).orderBy(idx))) | (F.col("__i") == 0)).cast("bigint"))
        marked = in_blocks(df.select(F.col(idx), by.alias("_b")), [idx], fresh, back=1)
        runs = scan(marked, [idx], F.col("_new"), "run").withColumn("run", F.col("run") - 1)
        return runs.groupBy("run").agg(F.min(idx).alias("first"), F.max(idx).alias("last"), F.count("*").alias("n"), F.first("_b").alias("value"))
    w = Window.partitionBy(*keys).orderBy(idx)
    marked = df.withColumn("_b", by).withColumn("_new", F.coalesce((~F.col("_b").eqNullSafe(F.lag("_b").over(w))).cast("int"), F.lit(1)))
    marked = marked.withColumn("_new", F.when(F.row_number().over(w) == 1, 1).otherwise(F.col("_new")))
    runs = marked.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return runs.groupBy(*keys, "run").agg(F.min(idx).alias("first"), F.max(idx).alias("last"), F.count("*").alias("n"), F.first("_b").alias("value"))


def argshuffle(df: DataFrame, idx: str, seed: int = 0) -> DataFrame:
    """pos, idx: a permutation that a seed repeats, by sorting on a hash."""
    return row_numbers(df.select(idx).withColumn("_h", F.xxhash64(F.lit(seed), idx)), ["_h", idx], "pos").select("pos", idx)


def is_ordered(df: DataFrame, x: str, idx: str, keys: list[str], descending: bool = False) -> DataFrame:
    """keys, ordered: whether each vector never falls (or rises)."""
    w = Window.partitionBy(*keys).orderBy(idx)
    before = F.lag(x).over(w)
    ok = F.col(x) <= before if descending else F.col(x) >= before
    return df.withColumn("_ok", F.coalesce(ok, F.lit(True))).groupBy(*keys).agg(F.bool_and("_ok").alias("ordered"))


def asof(left: DataFrame, right: DataFrame, on: str, value: str, keys: list[str]) -> DataFrame:
    """left with the value of the last right row at or before it, per key: one sort of both, no range join."""
    l = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType))
    r = right.select(*keys, on, F.col(value).alias("_v")).withColumn("_side", F.lit(0))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_side", "_v")
