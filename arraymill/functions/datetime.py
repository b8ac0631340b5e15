"""Dates and times: epochs, fields, calendar arithmetic and differences."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units in microseconds; a relative year has 365 days.
MICROSECONDS = {"microseconds": 1, "milliseconds": 1_000, "seconds": 1_000_000, "minutes": 60_000_000, "hours": 3_600_000_000, "days": 86_400_000_000, "weeks": 604_800_000_000, "years": 31_536_000_000_000}
_CALENDAR = {"years": "YEAR", "months": "MONTH", "weeks": "WEEK", "days": "DAY", "hours": "HOUR", "minutes": "MINUTE", "seconds": "SECOND", "milliseconds": "MILLISECOND", "microseconds": "MICROSECOND"}
_TEMPORAL = ("date", "timestamp", "timestamp_ntz")


def classify(kind: str, unit: str | None = None) -> str:
    """temporal, epoch, duration, relative or unknown, for a Spark type and a unit of its numbers."""
    if kind in _TEMPORAL:
        return "temporal"
    if kind.startswith("interval") or unit == "duration":
        return "duration"
    return "epoch" if unit and unit.startswith("epoch-") else "relative" if unit in MICROSECONDS else "unknown"


def is_datetime(kind: str) -> bool:
    return kind in _TEMPORAL


def is_duration(kind: str, unit: str | None = None) -> bool:
    return classify(kind, unit) == "duration"


def to_milliseconds(ts: Column, zone: str = "UTC") -> Column:
    """Milliseconds since the epoch as a double, NaN for null; zone is that of local times."""
    at = ts.cast("timestamp") if zone == "UTC" else F.to_utc_timestamp(ts.cast("timestamp"), zone)
    return F.coalesce((F.unix_micros(at) / 1000.0).cast("double"), F.lit(float("nan")))


def from_milliseconds(ms: Column, zone: str = "UTC") -> Column:
    d = ms.cast("double")
    ts = F.timestamp_millis(F.when(~F.isnan(d), d).cast("bigint"))
    return ts if zone == "UTC" else F.from_utc_timestamp(ts, zone)


def to_epoch(ts: Column, unit: str = "microseconds", zone: str = "UTC") -> Column:
    """Units since the epoch, truncated towards it."""
    at = ts.cast("timestamp") if zone == "UTC" else F.to_utc_timestamp(ts.cast("timestamp"), zone)
    us = F.unix_micros(at)
    return us if unit == "microseconds" else F.call_function("div", us, F.lit(MICROSECONDS[unit])).cast("int" if unit == "days" else "bigint")


def from_epoch(n: Column, unit: str = "microseconds", zone: str = "UTC") -> Column:
    ts = F.timestamp_micros(n.cast("bigint") * MICROSECONDS[unit])
    return ts if zone == "UTC" else F.from_utc_timestamp(ts, zone)


def field(ts: Column, name: str) -> Column:
    """A calendar field as bigint; weeks and days of the week by ISO (Monday is 1)."""
    return {
        "years": lambda: F.year(ts),
        "months": lambda: F.month(ts),
        "days": lambda: F.dayofmonth(ts),
        "day-of-year": lambda: F.dayofyear(ts),
        "day-of-week": lambda: F.weekday(ts) + 1,
        "iso-day-of-week": lambda: F.weekday(ts) + 1,
        "week-of-year": lambda: F.weekofyear(ts),
        "iso-week-of-year": lambda: F.weekofyear(ts),
        "epoch-days": lambda: F.unix_date(ts.cast("date")),
        "hours": lambda: F.hour(ts),
        "minutes": lambda: F.minute(ts),
        "seconds": lambda: F.second(ts),
        "milliseconds": lambda: F.pmod(F.unix_millis(ts.cast("timestamp")), F.lit(1000)),
    }[name]().cast("bigint")


FIELDS = ("years", "months", "days", "day-of-year", "day-of-week", "iso-day-of-week", "week-of-year", "iso-week-of-year", "epoch-days", "hours", "minutes", "seconds", "milliseconds")


def plus(ts: Column, n: Column, unit: str) -> Column:
    """Calendar arithmetic on timestamps."""
    return F.timestamp_add(_CALENDAR[unit], n.cast("int") if unit != "microseconds" else n, ts)


def minus(ts: Column, n: Column, unit: str) -> Column:
    return plus(ts, -n, unit)


def plus_epoch(t: Column, n: Column, of: str, unit: str) -> Column:
    """Adds units to a number of ``of`` since the epoch (or of a relative time), truncating to ``of``."""
    return F.call_function("div", t.cast("bigint") * MICROSECONDS[of] + n.cast("bigint") * MICROSECONDS[unit], F.lit(MICROSECONDS[of]))


def minus_epoch(t: Column, n: Column, of: str, unit: str) -> Column:
    return plus_epoch(t, -n, of, unit)


def between(a: Column, b: Column, unit: str, reverse: bool = False) -> Column:
    """Whole units from a to b (from b to a if reverse), truncated."""
    return F.timestamp_diff(_CALENDAR[unit], *((b, a) if reverse else (a, b))).cast("bigint")


def statistics(df: DataFrame, x: str, names: Iterable[str] = ("min", "mean", "max", "quartile_1", "quartile_3"), keys: list[str] | None = None, zone: str = "UTC") -> DataFrame:
    """keys and statistics of timestamps, taken in milliseconds; values that are times come back as timestamps, others stay milliseconds."""
    from arraymill.operators.stats import describe

    names = list(names)
    out = describe(df.withColumn("__ms", to_milliseconds(F.col(x), zone)), "__ms", names, keys)
    times = {"min", "max", "mean", "median", "quartile_1", "quartile_3"}
    return out.select(*(keys or []), *((from_milliseconds(F.floor(F.col(n)), zone) if n in times else F.col(n)).alias(n) for n in names))


def epoch_months(d: Column) -> Column:
    return ((F.year(d) - 1970) * 12 + F.month(d) - 1).cast("bigint")


def from_epoch_months(n: Column) -> Column:
    return F.add_months(F.lit("1970-01-01").cast("date"), n.cast("int"))


def epoch_days_to_months(n: Column) -> Column:
    return epoch_months(F.date_from_unix_date(n.cast("int")))


def epoch_months_to_days(n: Column) -> Column:
    return F.unix_date(from_epoch_months(n)).cast("bigint")


def local_date(ts: Column, zone: str = "UTC") -> Column:
    return (ts if zone == "UTC" else F.from_utc_timestamp(ts, zone)).cast("date")


def local_time_micros(ts: Column) -> Column:
    """Microseconds since midnight."""
    return F.pmod(F.unix_micros(ts.cast("timestamp")), F.lit(MICROSECONDS["days"]))


def at_time(d: Column, micros: Column, zone: str = "UTC") -> Column:
    """The instant of a local date and microseconds since midnight."""
    ts = F.timestamp_micros(F.unix_date(d).cast("bigint") * MICROSECONDS["days"] + micros.cast("bigint"))
    return ts if zone == "UTC" else F.to_utc_timestamp(ts, zone)


def zoned(ts: Column, zone: str) -> Column:
    """The wall clock of an instant in a zone."""
    return F.from_utc_timestamp(ts, zone)


def duration_nanos(a: Column, b: Column) -> Column:
    """Nanoseconds from a to b."""
    return (F.unix_micros(b) - F.unix_micros(a)) * 1000


def duration_millis(nanos: Column) -> Column:
    return F.call_function("div", nanos, F.lit(1_000_000))


def millis_duration(ms: Column) -> Column:
    return ms.cast("bigint") * 1_000_000


def pack(x: Column, kind: str) -> Column:
    """Dates as days, times as microseconds; null as the least value of the storage type."""
    if kind == "local-date":
        return F.coalesce(F.unix_date(x), F.lit(-(1 << 31)).cast("int"))
    return F.coalesce(F.unix_micros(x.cast("timestamp")), F.lit(-(1 << 63)).cast("bigint"))


def unpack(x: Column, kind: str) -> Column:
    if kind == "local-date":
        return F.date_from_unix_date(F.nullif(x, F.lit(-(1 << 31)).cast("int")))
    return F.timestamp_micros(F.nullif(x, F.lit(-(1 << 63)).cast("bigint")))
