"""A share of the registered queries against DuckDB; the driver compares all of them."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from arraymill.plans import catalog

DATA = "/root/testdata/sf0.001"
SOME = sorted(catalog.queries())[::17]


def rows(df):
    cell = lambda v: "~" if v is None or v != v else str(v) if isinstance(v, str | bool) else repr(round(float(v), 6) + 0.0)
    return sorted(tuple(cell(r[c]) for c in sorted(df.columns)) for r in df.to_dict("records"))


@pytest.mark.parametrize("name", SOME)
def test_query(spark, name):
    got = catalog.queries()[name](spark, DATA).toPandas()
    if name not in catalog.oracle_sql():
        assert len(got)
        return
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    assert all(a == b or all(x == y or math.isclose(float(x), float(y), rel_tol=1e-6, abs_tol=1e-5) for x, y in zip(a, b)) for a, b in zip(rows(got), rows(want)))


def test_entry_stands_alone(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def against_sql(spark, tmp_path, name, table, rows, schema):
    """The rows of a query and of its SQL over one small table."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    got = catalog.queries()[name](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    return rows_of(got), rows_of(con.sql(catalog.oracle_sql()[name]).df())


def rows_of(df):
    return rows(df.assign(value=df["value"].astype(float)))


CUSTOMER = "c_custkey long, c_nationkey int, c_acctbal double"


def test_remainder_at_halves(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "binary_ieee_remainder", "customer", [(k, 0, k * 3.65) for k in range(-999, 1000)], CUSTOMER)
    assert got == want


def test_significand_of_zero(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "unary_get_significand", "customer", [(k, 0, v) for k, v in enumerate((0.0, -0.0, 0.01, -999.99, 4096.0, 8191.99, None))], CUSTOMER)
    assert got == want


@pytest.mark.parametrize("name", ["stat_reduce_product", "stat_fold_opaque"])
def test_products_that_overflow(spark, tmp_path, name):
    got, want = against_sql(spark, tmp_path, name, "customer", [(k, k % 2, 0.0 if k % 2 and k > 9 else -5e4 if k % 10 < 4 else 1e5) for k in range(14000)], CUSTOMER)
    assert got == want and any(r[1] == "inf" for r in got)


def test_running_product_to_the_last_bit(spark, tmp_path):
    """Over more rows than a block, up to 1e150; the price of the first order is not known."""
    n = 70_000
    step = F.expm1(F.pmod(F.col("id") * 7919, F.lit(3001)) / 1e5 - 0.01)
    orders = spark.range(n).select(F.col("id").alias("o_orderkey"), F.when(F.col("id") > 0, 150000 + 1e9 * step).alias("o_totalprice"))
    orders.coalesce(3).write.parquet(f"{tmp_path}/orders.parquet")
    got = catalog.queries()["cumprod_whole"](spark, str(tmp_path)).orderBy("o_orderkey").toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = con.sql(catalog.oracle_sql()["cumprod_whole"]).df().sort_values("o_orderkey")
    assert got["o_orderkey"].tolist() == want["o_orderkey"].tolist() == list(range(1, n))
    assert got["value"].max() > 1e100 and got["value"].tolist() == want["value"].tolist()
