"""Windows over streams: the fixed and variable windows of rolling, by event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, ts: str, width: str, late: str, keys: list[str], aggs: dict[str, Column]) -> DataFrame:
    """Aggregates per window; rows later than ``late`` are left out. Works on batches too."""
    at = F.window(ts, width)
    out = df.withWatermark(ts, late).groupBy(at, *keys).agg(*(a.alias(n) for n, a in aggs.items()))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, *aggs)


def sliding(df: DataFrame, ts: str, width: str, step: str, late: str, keys: list[str], aggs: dict[str, Column]) -> DataFrame:
    out = df.withWatermark(ts, late).groupBy(F.window(ts, width, step), *keys).agg(*(a.alias(n) for n, a in aggs.items()))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, *aggs)


def session(df: DataFrame, ts: str, gap: str, late: str, keys: list[str], aggs: dict[str, Column]) -> DataFrame:
    out = df.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(*(a.alias(n) for n, a in aggs.items()))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, *aggs)
