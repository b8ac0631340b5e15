"""Index sets (bitmaps), ranges, samples and structs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def index_set(df: DataFrame, idx: str) -> DataFrame:
    """The distinct indexes of a column."""
    return df.select(F.col(idx).cast("bigint").alias("idx")).where("idx is not null").distinct()


def span(spark: SparkSession, start: int, stop: int, step: int = 1) -> DataFrame:
    """The indexes from start to stop, without stop."""
    return spark.range(start, stop, step).withColumnRenamed("id", "idx")


def reverse_span(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n - 1, -1, -1).withColumnRenamed("id", "idx")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """What is in one of them only."""
    both = a.withColumn("_n", F.lit(1)).union(b.withColumn("_n", F.lit(1)))
    return both.groupBy("idx").agg(F.sum("_n").alias("_n")).where("_n = 1").select("idx")


def reduce_union(sets: list[DataFrame]) -> DataFrame:
    out = sets[0]
    for s in sets[1:]:
        out = out.union(s)
    return out.distinct()


def reduce_intersection(sets: list[DataFrame]) -> DataFrame:
    out = sets[0]
    for s in sets[1:]:
        out = out.union(s)
    return out.groupBy("idx").count().where(F.col("count") == len(sets)).select("idx")


def offset(a: DataFrame, by: int) -> DataFrame:
    return a.select((F.col("idx") + by).alias("idx"))


def contains_range(a: DataFrame, start: int, stop: int) -> DataFrame:
    """holds: whether every index of the range is there."""
    return a.where(F.col("idx").between(start, stop - 1)).agg((F.count("*") == stop - start).alias("holds"))


def intersects_range(a: DataFrame, start: int, stop: int) -> DataFrame:
    return a.where(F.col("idx").between(start, stop - 1)).agg((F.count("*") > 0).alias("holds"))


def bounds(a: DataFrame) -> DataFrame:
    """least, most and contiguous (whether it is a range)."""
    n = F.count("*")
    return a.agg(F.min("idx").alias("least"), F.max("idx").alias("most"), ((F.max("idx") - F.min("idx") + 1) == n).alias("contiguous"))


def to_map(a: DataFrame, value: object) -> DataFrame:
    """Each index with a value."""
    return a.withColumn("value", F.lit(value))


def to_bitmaps(df: DataFrame, idx: str, keys: list[str] | None = None) -> DataFrame:
    """keys, bucket, bits: bitmaps of 32768 indexes, combined before the shuffle."""
    at = F.col(idx).cast("bigint")
    return df.groupBy(*(keys or []), F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))


def bitmaps_union(bitmaps: DataFrame) -> DataFrame:
    """n: the count of distinct indexes of a table of bitmaps."""
    return bitmaps.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits")).agg(F.sum(F.bitmap_count("bits")).alias("n"))


def reservoir(df: DataFrame, size: int, seed: int = 0, keys: list[str] | None = None, by: str | None = None) -> DataFrame:
    """size rows of each group (or of the table), drawn evenly; with ``by`` a seed repeats the draw whatever the partitions.

    The draw is a rank over random numbers, so each task sends on at most
    ``size`` rows of the table.
    """
    draw = F.xxhash64(F.lit(seed), by) if by else F.rand(seed)
    marked = df.withColumn("_draw", draw)
    if not keys:
        return marked.orderBy("_draw", *([by] if by else [])).limit(size).drop("_draw")
    w = Window.partitionBy(*keys).orderBy("_draw", *([by] if by else []))
    return marked.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= size).drop("_draw", "_rank")


def random_column(seed: int = 0, normal: bool = False) -> Column:
    return F.randn(seed) if normal else F.rand(seed)


def struct(fields: dict[str, Column]) -> Column:
    """A record from named columns; a record of records nests."""
    return F.struct(*(c.alias(n) for n, c in fields.items()))


def columns_of(record: str, names: list[str]) -> list[Column]:
    """The fields of an (array of) record(s) as columns."""
    return [F.col(f"{record}.{n}").alias(n) for n in names]


#: Sizes and alignments of C struct members.
_SIZES = {"int8": 1, "uint8": 1, "boolean": 1, "int16": 2, "uint16": 2, "int32": 4, "uint32": 4, "float32": 4, "int64": 8, "uint64": 8, "float64": 8}


def layout(fields: list[tuple[str, object, int]]) -> tuple[dict[str, int], int, int]:
    """Byte offsets of (name, type, count) members by C rules, with size and alignment; a type may be a layout's fields."""
    at, align, out = 0, 1, {}
    for name, kind, n in fields:
        inner = layout(kind) if isinstance(kind, list) else None
        size, need = (inner[1], inner[2]) if inner else (_SIZES[kind], _SIZES[kind])
        at = -(-at // need) * need
        out[name] = at
        if inner:
            out |= {f"{name}.{k}": at + v for k, v in inner[0].items()}
        at, align = at + size * n, max(align, need)
    return out, -(-at // align) * align, align


def spark_struct(fields: list[tuple[str, object, int]]) -> str:
    """The DDL of a struct layout."""
    from arraymill.types import spark_type

    def one(kind: object, n: int) -> str:
        base = spark_struct(kind) if isinstance(kind, list) else spark_type(kind)
        return base if n == 1 else f"array<{base}>"

    return "struct<" + ", ".join(f"{name}:{one(kind, n)}" for name, kind, n in fields) + ">"


def map_reduce(spark: SparkSession, n: int, f: Callable[[Column], Column], agg: Callable[[Column], Column]) -> DataFrame:
    """value: an aggregate of f over 0 ... n - 1."""
    return spark.range(n).agg(agg(f(F.col("id"))).alias("value"))


def map_reduce_opaque(spark: SparkSession, n: int, f: Callable[[np.ndarray], object], merge: Callable[[object, object], object], kind: str) -> DataFrame:
    """value: a Python function of blocks of the indexes 0 ... n - 1, combined by another, of a Spark type. A partition sends one row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [f(b["id"].to_numpy()) for b in batches if len(b)]
        if parts:
            yield pd.DataFrame({"value": [reduce(merge, parts)]})

    def end(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"value": [reduce(merge, g["value"].tolist())]})

    return spark.range(n).mapInPandas(run, f"value {kind}").withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(lambda g: end(g), f"value {kind}")
