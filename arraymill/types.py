"""Element types: names, widths, operation spaces, checked and wrapping casts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name: (Spark type, least value, largest value, wider types in order).
INTEGERS = {
    "int8": ("tinyint", -(1 << 7), (1 << 7) - 1),
    "int16": ("smallint", -(1 << 15), (1 << 15) - 1),
    "int32": ("int", -(1 << 31), (1 << 31) - 1),
    "int64": ("bigint", -(1 << 63), (1 << 63) - 1),
    "uint8": ("smallint", 0, (1 << 8) - 1),
    "uint16": ("int", 0, (1 << 16) - 1),
    "uint32": ("bigint", 0, (1 << 32) - 1),
    "uint64": ("bigint", 0, (1 << 63) - 1),
}
FLOATS = {"float32": "float", "float64": "double"}
OTHERS = {"boolean": "boolean", "string": "string", "keyword": "string", "uuid": "string", "local-date": "date", "instant": "timestamp", "local-date-time": "timestamp_ntz", "duration": "bigint"}
_ALIASES = {"byte": "int8", "short": "int16", "int": "int32", "long": "int64", "float": "float32", "double": "float64"}
_aliases = dict(_ALIASES)


def alias(new: str, old: str) -> None:
    """Registers another name for a type."""
    _aliases[new] = resolve(old)


def resolve(name: str) -> str:
    """The base name of a type."""
    return _aliases.get(name, name)


def spark_type(name: str) -> str:
    """The Spark type that stores an element type."""
    n = resolve(name)
    return INTEGERS[n][0] if n in INTEGERS else FLOATS.get(n) or OTHERS[n]


def is_integer(name: str) -> bool:
    return resolve(name) in INTEGERS


def is_float(name: str) -> bool:
    return resolve(name) in FLOATS


def width(name: str) -> int:
    """Bytes of an element."""
    n = resolve(name)
    return {"boolean": 1, "float32": 4, "float64": 8}.get(n) or int(n.strip("uint")) // 8


def operation_space(a: str, b: str | None = None) -> str:
    """int64 if all are integers, float64 if all are numbers, else object."""
    names = [resolve(x) for x in (a, b) if x]
    if all(n in INTEGERS for n in names):
        return "int64"
    return "float64" if all(n in INTEGERS or n in FLOATS for n in names) else "object"


def widest(a: str, b: str) -> str:
    """The narrowest type that holds all values of both."""
    a, b = resolve(a), resolve(b)
    if a == b:
        return a
    if "boolean" in (a, b):
        return b if a == "boolean" else a
    if a in INTEGERS and b in INTEGERS:
        lo, hi = min(INTEGERS[a][1], INTEGERS[b][1]), max(INTEGERS[a][2], INTEGERS[b][2])
        fits = [n for n, (_, x, y) in INTEGERS.items() if x <= lo and hi <= y and n in (a, b)] or [n for n in ("int16", "int32", "int64") if INTEGERS[n][1] <= lo and hi <= INTEGERS[n][2]]
        return "float64" if "uint64" in (a, b) and lo < 0 else fits[0] if fits else "float64"
    if a in (*INTEGERS, *FLOATS) and b in (*INTEGERS, *FLOATS):
        small = {"int8", "int16", "uint8", "uint16", "float32"}
        return "float32" if {a, b} <= small else "float64"
    return "object"


def cast(x: Column, name: str) -> Column:
    """A cast that fails on values out of range; floats are truncated, NaN is false as a boolean."""
    n = resolve(name)
    if n in INTEGERS:
        kind, lo, hi = INTEGERS[n]
        wide = x.cast("bigint")
        if n == "int64":
            return wide
        bad = F.raise_error(F.concat(F.lit(f"out of range of {n}: "), wide.cast("string")))
        return F.when(wide.isNull() | wide.between(lo, hi), wide.cast("bigint")).otherwise(bad.cast("bigint")).cast(kind)
    if n == "boolean":
        return truth(x)
    return x.cast(spark_type(n))


def truth(x: Column) -> Column:
    """Numbers as booleans: zero and NaN are false."""
    d = x.cast("double")
    return (d != 0) & ~F.isnan(d)


def unchecked(x: Column, name: str) -> Column:
    """A cast that wraps around; the result has the type that stores ``name``."""
    n = resolve(name)
    if n not in INTEGERS:
        return x.cast(spark_type(n))
    bits = 8 * width(n)
    wide = x.cast("bigint")
    if bits == 64:
        return wide
    low = wide.bitwiseAND(F.lit((1 << bits) - 1))
    if n.startswith("u"):
        return low.cast(spark_type(n))
    half = 1 << (bits - 1)
    return (low.bitwiseXOR(F.lit(half)) - half).cast(spark_type(n))
