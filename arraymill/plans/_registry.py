"""How queries are registered: a function over tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The supplied tables by name."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Registers a function of the tables, with its SQL if SQL can express it."""

    def put(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def num(x: Column, digits: int = 6) -> Column:
    """A double to compare: rounded, not finite as null."""
    d = x.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), F.round(d, digits) + 0.0)


def num_scaled(x: Column, digits: int = 6) -> Column:
    """num() by a multiplication and a division, as in SQL, where both show in the last bit of a large value."""
    d, scale = x.cast("double"), float(10**digits)
    a = F.abs(d) * scale
    low = F.floor(a).cast("double")
    whole = F.when(a >= float(1 << 52), a).otherwise(F.when(a - low >= 0.5, low + 1).otherwise(low))
    out = F.when(whole < float("inf"), F.signum(d) * (whole / scale)).otherwise(d)
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), out + 0.0)


def sql_num(x: str, digits: int = 6) -> str:
    return f"CASE WHEN isfinite(CAST({x} AS DOUBLE)) THEN round(CAST({x} AS DOUBLE), {digits}) + 0.0 END"
