"""Ordered operations over a whole table without gathering it in one task.

Rows are range partitioned by the order and sorted within, which is the only
shuffle; each partition's summary is one row, so the scan over summaries is as
small as the count of partitions; each row then adds what came before its
partition. Range bounds come from a sample that another run of the same plan
would draw anew, so the scanned rows are fixed in the shared folder before
their summaries are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from arraymill.store import fixed

_STEPS = {"sum": np.add, "min": np.minimum, "max": np.maximum}
_AGGS = {"sum": F.sum, "min": F.min, "max": F.max}
#: Children of a node in a tree of sums.
_FAN = 16


def scan(df: DataFrame, order: list[str | Column], value: Column, name: str, within: str = "sum") -> DataFrame:
    """df with a running sum, min or max of value in the order; nulls are passed over.

    Whole numbers are scanned as bigint, all others as double. Doubles are
    summed in extended precision within a partition, and a partition's total is
    the sum of its batches', so that errors do not grow with the count of rows.
    """
    whole = df.select(value.alias("v")).schema["v"].dataType.typeName() in ("byte", "short", "integer", "long")
    held = df.withColumn("__v", value.cast("bigint" if whole else "double"))
    parted = held.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    at, step = held.columns.index("__v"), _STEPS[within]
    blank = {"sum": 0, "min": np.iinfo(np.int64).max, "max": np.iinfo(np.int64).min} if whole else {"sum": 0.0, "min": np.inf, "max": -np.inf}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, met = blank[within], False
        for b in batches:
            if b.num_rows:
                column = b.column(at)
                good = column.is_valid().to_numpy(zero_copy_only=False)
                v = column.fill_null(blank[within]).to_numpy(zero_copy_only=False)
                own = step.accumulate(v if whole else v.astype(np.longdouble))
                out = step(own, last)
                seen = np.logical_or.accumulate(good) | met
                last, met = out[-1], bool(seen[-1])
                ends = np.arange(b.num_rows) == b.num_rows - 1
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x.astype(v.dtype), mask=~on) for x, on in ((out, seen), (own, ends & seen)))], [*b.schema.names, "__run", "__own"])

    kind = LongType() if whole else DoubleType()
    form = StructType([*parted.schema.fields, StructField("__run", kind), StructField("__own", kind)])
    inner = fixed(parted.sortWithinPartitions(*order).mapInArrow(run, form))
    totals = inner.groupBy("__part").agg(_AGGS[within]("__own").alias("__t"))  # a row per partition
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("__part", _AGGS[within]("__t").over(before).alias("__c"))
    both = inner.join(F.broadcast(carry), "__part")
    a, c = F.col("__run"), F.col("__c")
    joined = F.coalesce(a, F.lit(0)) + F.coalesce(c, F.lit(0)) if within == "sum" else (F.least if within == "min" else F.greatest)(a, c)
    return both.withColumn(name, joined).drop("__part", "__v", "__run", "__own", "__t", "__c")


def running_total(df: DataFrame, order: list[str | Column], value: str, name: str) -> DataFrame:
    return scan(df, order, F.col(value), name)


def _before(v: np.ndarray, start: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Per column of v the sum before each row that a block has room for, from start, and the block's own sum; both by its tree."""
    nodes = [np.zeros((_FAN**levels, v.shape[1]))]
    nodes[0][: len(v)] = v
    for _ in range(levels):
        nodes.append(np.add.accumulate(nodes[-1].reshape(-1, _FAN, v.shape[1]), axis=1)[:, -1])
    out = start[None]
    for level in reversed(nodes[:-1]):
        own = level.reshape(-1, _FAN, v.shape[1])[:, :-1]
        out = np.add.accumulate(np.concatenate([out[:, None], own], axis=1), axis=1).reshape(-1, v.shape[1])
    return out, nodes[-1][0]


def tree_sums(df: DataFrame, order: list[str | Column], values: dict[str, Column], levels: int = 3) -> DataFrame:
    """df with the running sum of each of values (doubles) by its name, in a total order; nulls count as 0.

    Rows are the leaves of a tree in which 16 nodes in order have one above
    them. A running sum adds the nodes that end before or at its row, the
    largest first. So it hangs on values and positions alone, not on the
    partitions, its error grows with the logarithm of the count of rows, and it
    is to the last bit what an engine gives whose windows are such trees
    (DuckDB's are). Tasks work on subtrees of so many levels.
    """
    held = row_numbers(df, order, "__i").select("__i", *df.columns, *(F.coalesce(v.cast("double"), F.lit(0.0)).alias(n) for n, v in values.items()))
    return _along(held, list(values), levels).drop("__i")


def _along(rows: DataFrame, names: list[str], levels: int) -> DataFrame:
    """rows, numbered by __i, with running sums in place of the columns names; blocks of rows are subtrees, and the rows of the next round."""
    size = _FAN**levels
    held = rows.withColumn("__b", F.floor(F.col("__i") / size).cast("bigint"))
    form = StructType([StructField(n, LongType() if n == "__i" else DoubleType()) for n in ("__i", *names)])

    def laid(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(t["__i"].to_numpy())
        return order, np.stack([t[n].to_numpy() for n in names], axis=1)[order]

    def total(key: tuple, t: pa.Table) -> pa.Table:
        own = _before(laid(t)[1], np.zeros(len(names)), levels)[1]
        return pa.table([pa.array([key[0].as_py()]), *(pa.array([x]) for x in own)], form.names)

    def run(key: tuple, t: pa.Table, ends: pa.Table) -> pa.Table:
        if not t.num_rows:
            return t.drop_columns("__b")
        order, v = laid(t)
        at = {i: np.array(x) for i, *x in zip(*(ends[n].to_pylist() for n in form.names), strict=True)}
        b = key[0].as_py()
        before, _ = _before(v, at.get(b - 1, np.zeros(len(names))), levels)
        sums = np.concatenate([before[1:], at[b][None]])[: len(v)]
        out = t.take(pa.array(order)).drop_columns("__b")
        for k, n in enumerate(names):
            out = out.set_column(out.column_names.index(n), n, pa.array(sums[:, k]))
        return out

    totals = fixed(held.select("__b", "__i", *names).groupBy("__b").applyInArrow(total, form))
    ends = totals if totals.limit(2).count() < 2 else _along(totals, names, levels)
    ends = ends.withColumn("__b", F.explode(F.array("__i", F.col("__i") + 1)))  # each block needs its own and that before it
    return held.groupBy("__b").cogroup(ends.groupBy("__b")).applyInArrow(run, rows.schema)


def same_keys(left: list[str], right: list[str]) -> Column:
    """Equality of keys in which null is a value."""
    return reduce(lambda a, b: a & b, (F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right, strict=True)))


def scan_within(df: DataFrame, keys: list[str], order: list[str | Column], value: Column, name: str) -> DataFrame:
    """df with a running sum of value (not null) within each group of keys; a group may be larger than a task.

    One scan over keys and order; what came before a group is the least sum
    before any of its rows, which is combined before it is shuffled.
    """
    held = scan(df.withColumn("__w", value), [*keys, *order], F.col("__w"), "__all")
    own = [f"__of{i}" for i in range(len(keys))]
    starts = held.groupBy(*(F.col(k).alias(o) for k, o in zip(keys, own, strict=True))).agg(F.min(F.col("__all") - F.col("__w")).alias("__s"))
    both = held.join(starts, same_keys(keys, own))
    return both.withColumn(name, F.col("__all") - F.col("__s")).select(*df.columns, name)


def positions_within(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "pos") -> DataFrame:
    """df with positions from 0 within each group of keys, in a total order; a group may be larger than a task."""
    return scan_within(df, keys, order, F.lit(1).cast("bigint"), name).withColumn(name, F.col(name) - 1)


def in_blocks(df: DataFrame, order: list[str | Column], f: Callable[[DataFrame, list[str]], DataFrame], back: int = 0, ahead: int = 0, block: int = 1 << 16) -> DataFrame:
    """f over one ordered vector without keys, in blocks of rows with the rows within reach of each.

    f gets rows and the keys that tell the blocks apart, and must keep the rows
    and all their columns; what it gives for rows of other blocks is left out.
    The first and last block end where the vector does.
    """
    held = row_numbers(df, order, "__i")
    near = F.sequence(F.greatest(F.floor((F.col("__i") - ahead) / block), F.lit(0)), F.floor((F.col("__i") + back) / block))
    done = f(held.withColumn("__b", F.explode(near)), ["__b"])
    return done.where(F.floor(F.col("__i") / block) == F.col("__b")).drop("__i", "__b")


def row_numbers(df: DataFrame, order: list[str | Column], name: str = "idx") -> DataFrame:
    """df with positions from 0 in a total order."""
    return scan(df, order, F.lit(1).cast("bigint"), name).withColumn(name, F.col(name) - 1)
