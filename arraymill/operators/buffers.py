"""Containers and views of long vectors: a DataFrame with idx and value columns."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arraymill import types


def container(spark: SparkSession, kind: str, values: list | int) -> DataFrame:
    """idx, v from a list or, zeros, from a count."""
    if isinstance(values, int):
        return spark.range(values).select(F.col("id").alias("idx"), types.cast(F.lit(0), kind).alias("v"))
    raw = spark.createDataFrame([(i, None if v is None else str(v)) for i, v in enumerate(values)], "idx bigint, v string")
    return raw.select("idx", types.cast(F.col("v").cast("double") if types.is_integer(kind) or types.is_float(kind) else F.col("v"), kind).alias("v"))


def reader(spark: SparkSession, n: int, f: Callable[[Column], Column]) -> DataFrame:
    """A vector computed from its index."""
    return spark.range(n).select(F.col("id").alias("idx"), f(F.col("id")).alias("v"))


def constant(spark: SparkSession, value: object, n: int) -> DataFrame:
    return reader(spark, n, lambda _: F.lit(value))


def without_nan(df: DataFrame, v: str = "v", nan: str = "remove") -> DataFrame:
    """A NaN strategy on rows."""
    bad = F.isnan(F.col(v).cast("double"))
    if nan == "remove":
        return df.where(~bad)
    return df.withColumn(v, F.when(bad, F.raise_error(F.lit("NaN in the data")).cast("double")).otherwise(F.col(v))) if nan == "exception" else df


def to_array(df: DataFrame, idx: str = "idx", v: str = "v") -> list[Any]:
    """The values on the driver, for small vectors."""
    return [r[0] for r in df.orderBy(idx).select(v).collect()]


def sub_buffer(df: DataFrame, offset: int, length: int, idx: str = "idx") -> DataFrame:
    return df.where(F.col(idx).between(offset, offset + length - 1)).withColumn(idx, F.col(idx) - offset)


def gather(df: DataFrame, indexes: DataFrame, idx: str = "idx", v: str = "v") -> DataFrame:
    """pos, v for rows (pos, idx) of indexes, repeats allowed."""
    return indexes.select("pos", idx).join(df.select(idx, v), idx).select("pos", v)


def concatenated(parts: list[tuple[DataFrame, int]], idx: str = "idx", v: str = "v") -> DataFrame:
    """Vectors with their lengths, one after the other."""
    out, at = None, 0
    for df, n in parts:
        moved = df.select((F.col(idx) + at).alias(idx), v)
        out, at = moved if out is None else out.unionByName(moved), at + n
    return out


def reverse(df: DataFrame, n: int, idx: str = "idx") -> DataFrame:
    return df.withColumn(idx, n - 1 - F.col(idx))


def get_value(df: DataFrame, at: int, idx: str = "idx", v: str = "v") -> DataFrame:
    return df.where(F.col(idx) == at).select(v)


def set_value(df: DataFrame, at: int, value: object, idx: str = "idx", v: str = "v") -> DataFrame:
    return df.withColumn(v, F.when(F.col(idx) == at, F.lit(value)).otherwise(F.col(v)))


def set_constant(df: DataFrame, offset: int, length: int, value: object, idx: str = "idx", v: str = "v") -> DataFrame:
    return df.withColumn(v, F.when(F.col(idx).between(offset, offset + length - 1), F.lit(value)).otherwise(F.col(v)))


def updated(df: DataFrame, updates: DataFrame, idx: str = "idx", v: str = "v") -> DataFrame:
    """The vector with the rows of updates in place of its own."""
    new = updates.select(idx, F.col(v).alias("_new"), F.lit(True).alias("_set"))
    return df.join(new, idx, "left").withColumn(v, F.when(F.col("_set"), F.col("_new")).otherwise(F.col(v))).drop("_new", "_set")


def coalesce(df: DataFrame, nested: str, order: str) -> DataFrame:
    """Ragged arrays in order as one vector."""
    from arraymill.operators.prefix import row_numbers

    flat = df.select(order, F.posexplode(nested).alias("_k", "v"))
    return row_numbers(flat, [order, "_k"], "idx").select("idx", "v")


def count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def emap(df: DataFrame, f: Callable[..., Column], *columns: str, name: str = "value", kind: str | None = None) -> DataFrame:
    """An elementwise function of columns; f returns a column, or is a pandas UDF."""
    out = f(*(F.col(c) for c in columns))
    return df.withColumn(name, types.cast(out, kind) if kind else out)


def zipped(a: DataFrame, b: DataFrame, f: Callable[[Column, Column], Column], idx: str = "idx", v: str = "v") -> DataFrame:
    """An operation over two vectors, as long as the shorter."""
    both = a.select(idx, F.col(v).alias("_a")).join(b.select(idx, F.col(v).alias("_b")), idx)
    return both.select(idx, f(F.col("_a"), F.col("_b")).alias(v))
