import math

import pytest
from pyspark.sql import functions as F

from arraymill import types
from arraymill.functions import cells, expr
from arraymill.functions import datetime as dt

NAN, INF = float("nan"), float("inf")


def column(df, c):
    return [r[0] for r in df.orderBy("idx").select(c).collect()]


def same(a, b):
    return len(a) == len(b) and all(x == y or (isinstance(x, float) and isinstance(y, float) and (math.isnan(x) and math.isnan(y) or math.isclose(x, y, rel_tol=1e-9))) for x, y in zip(a, b))


@pytest.mark.parametrize(
    ("name", "data", "want"),
    [
        ("round", [2.2, 2.8, 3.5, 4.6, -2.5], [2, 3, 4, 5, -2]),
        ("floor", [2.2, 2.8, -3.5, NAN, INF, 1e300], [2.0, 2.0, -4.0, NAN, INF, 1e300]),
        ("ceil", [2.2, 3.0, -3.5, -INF], [3.0, 3.0, -3.0, -INF]),
        ("rint", [0.5, 1.5, 2.5], [0.0, 2.0, 2.0]),
        ("sq", [1, 2, 3, 4], [1.0, 4.0, 9.0, 16.0]),
        ("log", [0, -1, 1, NAN], [-INF, NAN, 0.0, NAN]),
        ("log10", [0, 100], [-INF, 2.0]),
        ("log1p", [-1, -2, 0], [-INF, NAN, 0.0]),
        ("sqrt", [4, -1], [2.0, NAN]),
        ("logistic", [0], [0.5]),
        ("next_up", [1.0], [1.0000000000000002]),
        ("next_down", [1.0], [0.9999999999999999]),
        ("ulp", [1.0, -1.0], [2.220446049250313e-16] * 2),
        ("get_significand", [1.0, 0.75], [float(1 << 52), 1.5 * (1 << 52)]),
        ("to_long", [2.9, -2.9], [2, -2]),
        ("reciprocal", [0, -0.5, NAN], [INF, -2.0, NAN]),
    ],
)
def test_unary(vector, name, data, want):
    assert same(column(vector(data), expr.UNARY[name](F.col("v"))), want)


@pytest.mark.parametrize(
    ("name", "x", "y", "want"),
    [
        ("divide", [1, -1, 0, 3], 0, [INF, -INF, NAN, INF]),
        ("quot", [7, -7, 1], 2, [3.0, -3.0, 0.0]),
        ("rem", [12.3, 11.3, 10.3], 4.4, [3.5, 2.5, 1.5]),
        ("atan2", [2, 3, 4, 5], 5, [math.atan2(k, 5) for k in (2, 3, 4, 5)]),
        ("pow", [0, 1, 2], 2, [0.0, 1.0, 4.0]),
        ("max", [1, NAN, 5], 3, [3.0, 3.0, 5.0]),
        ("min", [1, NAN, 5], 3, [1.0, NAN, 3.0]),
        ("ieee_remainder", [5, 7, 6, -5], 4, [math.remainder(k, 4) for k in (5, 7, 6, -5)]),
        ("hypot", [3], 4, [5.0]),
    ],
)
def test_binary(vector, name, x, y, want):
    got = column(vector(x), expr.BINARY[name](F.col("v"), F.lit(float(y))))
    assert all(math.isclose(a, b, abs_tol=1e-9) or a == b or (math.isnan(a) and math.isnan(b)) for a, b in zip(got, want))


def test_predicates_with_nan(vector):
    d = vector([0, NAN, 2, 4, NAN])
    assert column(d, expr.UNARY_PREDICATES["is_nan"](F.col("v"))) == [False, True, False, False, True]
    assert column(d, expr.BINARY_PREDICATES["eq"](F.col("v"), F.lit(NAN))) == [False, True, False, False, True]
    for name in ("gt", "gte", "lt", "lte"):
        assert column(d, expr.BINARY_PREDICATES[name](F.col("v"), F.lit(1.0)))[1] is False
    assert column(d, expr.UNARY_PREDICATES["not"](F.col("v"))) == [True, True, False, False, True]
    assert column(vector(range(10)), expr.chain("lt", F.lit(2.0), F.col("v"), F.lit(7.0))) == [k in (3, 4, 5, 6) for k in range(10)]


def test_bits(spark):
    d = spark.range(8).withColumnRenamed("id", "idx")
    x = F.col("idx")
    assert column(d, expr.BINARY["bit_set"](x, F.lit(0))) == [k | 1 for k in range(8)]
    assert column(d, expr.BINARY["bit_clear"](x, F.lit(1))) == [k & ~2 for k in range(8)]
    assert column(d, expr.BINARY["bit_flip"](x, F.lit(2))) == [k ^ 4 for k in range(8)]
    assert column(d, expr.BINARY["unsigned_bit_shift_right"](x - 8, F.lit(60))) == [15] * 8
    assert column(d, expr.BINARY_PREDICATES["bit_test"](x, F.lit(1))) == [bool(k & 2) for k in range(8)]


def test_types(spark):
    d = spark.range(300).withColumnRenamed("id", "idx")
    assert column(d, types.unchecked(F.col("idx"), "int8")) == [((k & 255) ^ 128) - 128 for k in range(300)]
    with pytest.raises(Exception, match="out of range"):
        d.select(types.cast(F.col("idx"), "uint8")).collect()
    assert types.widest("int8", "uint8") == "int16" and types.widest("uint32", "int32") == "int64" and types.widest("int32", "float32") == "float64"
    assert types.operation_space("int8", "uint8") == "int64" and types.operation_space("int8", "float32") == "float64"
    types.alias("myint", "int")
    assert types.spark_type("myint") == "int" and types.width("uint16") == 2
    assert spark.range(1).select(types.truth(F.lit(NAN)), types.truth(F.lit(0)), types.truth(F.lit(1))).first()[:] == (False, False, True)


def test_dates(spark):
    d = spark.sql("select timestamp'1969-12-31 23:59:59.5' as t, timestamp'2024-02-29 01:02:03' as u, date'2024-03-31' as d, cast(null as date) as n")
    r = d.select(
        dt.to_epoch(F.col("t"), "seconds"), dt.field(F.col("u"), "day-of-week"), dt.field(F.col("u"), "iso-week-of-year"),
        dt.between(F.col("u"), dt.plus(F.col("u"), F.lit(3), "days"), "days"), F.unix_date(dt.minus(F.col("d").cast("timestamp"), F.lit(1), "months").cast("date")),
        dt.pack(F.col("n"), "local-date"), dt.unpack(dt.pack(F.col("n"), "local-date"), "local-date"), dt.to_milliseconds(F.col("n")),
    ).first()
    assert r[:4] == (0, 4, 9, 3) and r[4] == 19782 and r[5] == -(1 << 31) and r[6] is None and math.isnan(r[7])
    assert dt.classify("timestamp") == "temporal" and dt.classify("bigint", "days") == "relative" and dt.classify("bigint", "epoch-days") == "epoch"


def test_cells(spark):
    d = spark.createDataFrame([([3.0, 1.0, 2.0],)], "a array<double>")
    a = F.col("a")
    got = d.select(cells.argsort(a), cells.argmin(a), cells.argmax(a), cells.get(a, -1), cells.cumsum(a), cells.dot(a, a), cells.argfilter(a, lambda x: x > 1), cells.index_of(a, F.lit(9.0)), cells.normalize(F.array(F.lit(3.0), F.lit(4.0)))).first()
    assert got[:] == ([1, 2, 0], 1, 0, 2.0, [3.0, 4.0, 6.0], 14.0, [0, 2], 3, [0.6, 0.8])


def test_remainder_of_a_quotient_that_rounds_to_a_half(spark):
    d = spark.createDataFrame([(10.95,), (-10.95,), (18.25,), (3.65,), (5.0,), (None,)], "x double")
    got = [r[0] for r in d.select(F.round(expr.nearest_remainder(F.col("x"), F.lit(7.3)), 6)).collect()]
    assert got == [-3.65, 3.65, 3.65, 3.65, -2.3, None]
