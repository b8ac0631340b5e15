"""Queries for reductions, statistics and correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from arraymill.operators import argops, stats

from ._registry import Tables, num, query, sql_num

_LINE = "lineitem GROUP BY l_returnflag"


@query(
    "flagship_revenue_stats",
    f"""SELECT l_returnflag, count(*) AS n, {sql_num('avg(r)')} AS mean, {sql_num('stddev_samp(r)', 4)} AS sd,
    {sql_num('skewness(r)')} AS skew, {sql_num('list_sort(list(r))[count(*) // 2 + 1]')} AS median
    FROM (SELECT l_returnflag, l_extendedprice * (1 - l_discount) AS r FROM lineitem) GROUP BY l_returnflag""",
)
def _flagship(t: Tables):
    r = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    d = stats.describe(t.lineitem.select("l_returnflag", r.alias("r")), "r", ("n_elems", "mean", "standard_deviation", "skew", "median"), ["l_returnflag"])
    return d.select("l_returnflag", F.col("n_elems").alias("n"), num(F.col("mean")).alias("mean"), num(F.col("standard_deviation"), 4).alias("sd"), num(F.col("skew")).alias("skew"), num(F.col("median")).alias("median"))


#: x has NaN where the quantity is 13.
_X = "CASE WHEN l_quantity <> 13 THEN l_extendedprice END"
_AGGS = {
    "sum": (lambda x: stats.total(x), f"sum({_X})", 2),
    "sum_exact": (lambda x: stats.total_exact(x), f"sum(CAST({_X} AS DECIMAL(28, 9)))", 2),
    "sum_fast": (lambda x: stats.sum_fast(F.nanvl(x, F.lit(0.0))), f"sum({_X})", 2),
    "mean": (lambda x: stats.mean(x), f"avg({_X})", 6),
    "mean_fast": (lambda x: stats.mean_fast(F.nanvl(x, F.lit(0.0))), f"sum({_X}) / count(*)", 6),
    "min": (lambda x: stats.least(x), f"min({_X})", 6),
    "max": (lambda x: stats.most(x), f"max({_X})", 6),
    "n_values": (lambda x: stats.n_values(x), f"count({_X})", 0),
    "variance": (lambda x: stats.variance(x), f"var_samp({_X})", 2),
    "standard_deviation": (lambda x: stats.standard_deviation(x), f"stddev_samp({_X})", 5),
    "skew": (lambda x: stats.skew(x), f"skewness({_X})", 6),
    "kurtosis": (lambda x: stats.kurtosis(x), f"kurtosis({_X})", 6),
    "moment_2": (lambda x: stats.moment(x, 2) / 1e10, f"var_pop({_X}) * count({_X}) / 1e10", 4),
    "moment_3": (lambda x: stats.moment(x, 3) / 1e15, f"skewness({_X}) * (count({_X}) - 2) / sqrt(CAST(count({_X}) AS DOUBLE) * (count({_X}) - 1)) * pow(var_pop({_X}), 1.5) * count({_X}) / 1e15", 4),
    "moment_4": (lambda x: stats.moment(x, 4) / 1e20, f"(kurtosis_pop({_X}) + 3) * pow(var_pop({_X}), 2) * count({_X}) / 1e20", 4),
    "median": (None, f"list_sort(list({_X}) FILTER (WHERE l_quantity <> 13))[count({_X}) // 2 + 1]", 6),
    "reduce_add": (lambda x: stats.fold("add", F.nanvl(x, F.lit(0.0))), f"sum({_X})", 2),
    "reduce_min": (lambda x: stats.fold("min", F.nanvl(x, F.lit(5e4))), "min(CASE WHEN l_quantity <> 13 THEN l_extendedprice ELSE 50000 END)", 6),
    "reduce_max": (lambda x: stats.fold("max", F.nanvl(x, F.lit(5e4))), "max(CASE WHEN l_quantity <> 13 THEN l_extendedprice ELSE 50000 END)", 6),
    "unary_summation": (lambda x: stats.summation(lambda v: F.sqrt(v), x), f"sum(sqrt({_X}))", 2),
    "magnitude_squared": (lambda x: stats.magnitude_squared(F.nanvl(x, F.lit(0.0))) / 1e9, f"sum({_X} * {_X}) / 1e9", 5),
    "magnitude": (lambda x: stats.magnitude(F.nanvl(x, F.lit(0.0))), f"sqrt(sum({_X} * {_X}))", 4),
    "quartile_1": (None, None, 5),
    "quartile_3": (None, None, 5),
}


def _legacy(p: float) -> str:
    s, n = "list_sort(list(x))", "count(x)"
    pos = f"({p} * ({n} + 1))"
    lo, hi = f"greatest(1, least({n}, CAST(floor{pos} AS BIGINT)))", f"greatest(1, least({n}, CAST(floor{pos} AS BIGINT) + 1))"
    return f"({s}[{lo}] + ({pos} - floor{pos}) * ({s}[{hi}] - {s}[{lo}]))"


def _of(kind: str, p: float) -> str:
    """A percentile of x by estimation type, in SQL."""
    s, n = "list_sort(list(x))", "count(x)"
    place = {"legacy": f"{p} * ({n} + 1)", "r1": f"{n} * {p}", "r2": f"{n} * {p}", "r3": f"round_even({n} * {p}, 0)", "r4": f"{n} * {p}", "r5": f"{n} * {p} + 0.5", "r6": f"({n} + 1) * {p}", "r7": f"({n} - 1) * {p} + 1", "r8": f"({n} + 1.0 / 3) * {p} + 1.0 / 3", "r9": f"({n} + 0.25) * {p} + 0.375"}[kind]
    at = lambda k: f"{s}[greatest(1, least({n}, CAST({k} AS BIGINT)))]"
    pos = f"CAST({place} AS DOUBLE)"
    if kind == "r1":
        return at(f"ceil({pos})")
    if kind == "r2":
        return f"({at(f'ceil({pos})')} + {at(f'floor({pos}) + 1')}) / 2"
    if kind == "r3":
        return at(pos)
    return f"({at(f'floor({pos})')} + ({pos} - floor({pos})) * ({at(f'floor({pos}) + 1')} - {at(f'floor({pos})')}))"


def _agg(name: str, f, sql: str | None, digits: int) -> None:
    if sql is None:
        p = 0.25 if name.endswith("1") else 0.75
        text = f"SELECT l_returnflag, {sql_num(_of('legacy', p), digits)} AS value FROM (SELECT l_returnflag, {_X} AS x FROM lineitem WHERE l_quantity <> 13) GROUP BY l_returnflag"
    else:
        text = f"SELECT l_returnflag, {sql_num(sql, digits)} AS value FROM {_LINE}"

    @query(f"stat_{name}", text)
    def run(t: Tables):
        x = F.when(F.col("l_quantity") == 13, float("nan")).otherwise(F.col("l_extendedprice"))
        d = t.lineitem.select("l_returnflag", x.alias("x"))
        if f is None:  # an order statistic
            return stats.describe(d, "x", [name], ["l_returnflag"]).select("l_returnflag", num(F.col(name), digits).alias("value"))
        return d.groupBy("l_returnflag").agg(num(f(F.col("x")), digits).alias("value"))


for _n, (_f, _sql, _digits) in _AGGS.items():
    _agg(_n, _f, _sql, _digits)

for _kind in (k for k in stats._KINDS if k != "upper"):

    @query(f"percentiles_{_kind}", f"SELECT c_nationkey, {sql_num(_of(_kind, 0.1), 5)} AS p10, {sql_num(_of(_kind, 0.5), 5)} AS p50, {sql_num(_of(_kind, 0.9), 5)} AS p90 FROM (SELECT c_nationkey, c_acctbal AS x FROM customer) GROUP BY c_nationkey")
    def _percentiles(t: Tables, kind: str = _kind):
        p = stats.quantiles(t.customer, "c_acctbal", (10, 50, 90), kind, ["c_nationkey"], name="p")
        return p.select("c_nationkey", num(F.col("p")[0], 5).alias("p10"), num(F.col("p")[1], 5).alias("p50"), num(F.col("p")[2], 5).alias("p90"))


@query("stat_quartiles", f"SELECT c_nationkey, {sql_num('min(x)', 5)} AS q0, {sql_num(_of('legacy', 0.25), 5)} AS q1, {sql_num(_of('legacy', 0.5), 5)} AS q2, {sql_num(_of('legacy', 0.75), 5)} AS q3, {sql_num('max(x)', 5)} AS q4 FROM (SELECT c_nationkey, c_acctbal AS x FROM customer) GROUP BY c_nationkey")
def _quartiles(t: Tables):
    q = stats.quantiles(t.customer, "c_acctbal", (0.001, 25, 50, 75, 100), keys=["c_nationkey"], name="q")
    return q.select("c_nationkey", *(num(F.col("q")[k], 5).alias(f"q{k}") for k in range(5)))


@query("stat_reduce_product", "SELECT c_nationkey, round(product(1 + c_acctbal / 100000), 6) + 0.0 AS value FROM customer GROUP BY c_nationkey")
def _product(t: Tables):
    return t.customer.groupBy("c_nationkey").agg((F.round(stats.product(1 + F.col("c_acctbal") / 100000), 6) + 0.0).alias("value"))  # infinite where it overflows, as in SQL


@query("stat_fold_opaque", "SELECT c_nationkey, round(product(1 + c_acctbal / 100000) - 1, 6) + 0.0 AS value FROM customer GROUP BY c_nationkey")
def _opaque_fold(t: Tables):
    d = t.customer.select("c_nationkey", (F.col("c_acctbal") / 100000).alias("x"))
    both = lambda a, b: (1 + a) * (1 + b) - 1  # noqa: E731  a + b + a * b would be inf - inf once a part overflows
    return stats.fold_by(d, both, "x", ["c_nationkey"], chunk=64).withColumn("value", F.round("value", 6) + 0.0)


@query("percentiles_small_groups", f"SELECT user_id, {sql_num(_of('legacy', 0.5), 5)} AS p50, {sql_num('list_sort(list(x))[count(*) // 2 + 1]', 5)} AS middle FROM (SELECT user_id, value AS x FROM events) GROUP BY user_id")
def _small_groups(t: Tables):
    d = t.events.groupBy("user_id").agg(stats.percentiles(F.col("value"), (50,)).alias("p"), stats.median(F.col("value")).alias("m"))
    return d.select("user_id", num(F.col("p")[0], 5).alias("p50"), num(F.col("m"), 5).alias("middle"))


@query("quantiles_whole", f"SELECT {sql_num(_of('r7', 0.25), 5)} AS q1, {sql_num(_of('r7', 0.5), 5)} AS q2, {sql_num(_of('r7', 0.99), 5)} AS q99 FROM (SELECT l_extendedprice AS x FROM lineitem)")
def _whole_quantiles(t: Tables):
    p = stats.quantiles(t.lineitem, "l_extendedprice", (25, 50, 99), "r7", name="p")
    return p.select(num(F.col("p")[0], 5).alias("q1"), num(F.col("p")[1], 5).alias("q2"), num(F.col("p")[2], 5).alias("q99"))


@query("stat_mode", "SELECT o_orderstatus, arg_min(o_orderpriority, (-n, o_orderpriority)) AS mode FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_orderstatus")
def _mode(t: Tables):
    return stats.mode(t.orders, "o_orderpriority", ["o_orderstatus"])


@query("stat_outliers", f"SELECT user_id, event_id, value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS outlier FROM events JOIN (SELECT user_id, {_of('legacy', 0.25)} AS q1, {_of('legacy', 0.75)} AS q3 FROM (SELECT user_id, value AS x FROM events) GROUP BY user_id) USING (user_id)")
def _outliers(t: Tables):
    return stats.outliers(t.events, "value", ["user_id"]).select("user_id", "event_id", "outlier")


@query("stat_describe", f"SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n_elems, {sql_num('min(c_acctbal)')} AS least, {sql_num('avg(c_acctbal)')} AS middle, {sql_num('max(c_acctbal)')} AS most, {sql_num('stddev_samp(c_acctbal)')} AS sd FROM customer GROUP BY c_mktsegment")
def _describe(t: Tables):
    d = stats.describe(t.customer, "c_acctbal", keys=["c_mktsegment"])
    return d.select("c_mktsegment", "n_elems", num(F.col("min")).alias("least"), num(F.col("mean")).alias("middle"), num(F.col("max")).alias("most"), num(F.col("standard_deviation")).alias("sd"))


@query("corr_pearson", f"SELECT l_returnflag, {sql_num('corr(l_quantity, l_extendedprice)')} AS value FROM {_LINE}")
def _pearson(t: Tables):
    return t.lineitem.groupBy("l_returnflag").agg(num(stats.pearson(F.col("l_quantity"), F.col("l_extendedprice"))).alias("value"))


_RANKED = "SELECT user_id, rank() OVER (PARTITION BY user_id ORDER BY value) + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2.0 AS a, rank() OVER (PARTITION BY user_id ORDER BY event_id % 10) + (count(*) OVER (PARTITION BY user_id, event_id % 10) - 1) / 2.0 AS b FROM events"


@query("corr_spearman", f"SELECT user_id, {sql_num('corr(a, b)')} AS value FROM ({_RANKED}) GROUP BY user_id")
def _spearman(t: Tables):
    d = stats.spearman(t.events.withColumn("d", F.col("event_id") % 10), "value", "d", ["user_id"])
    return d.select("user_id", num(F.col("spearman")).alias("value"))


@query("corr_spearman_whole", "SELECT round(corr(a, b), 6) + 0.0 AS value FROM (SELECT rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS a, rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2.0 AS b FROM orders)")
def _spearman_whole(t: Tables):
    return stats.spearman(t.orders, "o_totalprice", "o_custkey").select(num(F.col("spearman")).alias("value"))


@query(
    "corr_kendall",
    f"""SELECT c_nationkey, {sql_num('sum(sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(sum(CASE WHEN a.x <> b.x THEN 1 ELSE 0 END) * sum(CASE WHEN a.y <> b.y THEN 1.0 ELSE 0 END))')} AS value
    FROM (SELECT c_nationkey, c_custkey, c_acctbal AS x, c_custkey % 7 AS y FROM customer) a JOIN (SELECT c_nationkey, c_custkey, c_acctbal AS x, c_custkey % 7 AS y FROM customer) b USING (c_nationkey) WHERE a.c_custkey < b.c_custkey GROUP BY c_nationkey""",
)
def _kendall(t: Tables):
    d = stats.kendall(t.customer.withColumn("y", F.col("c_custkey") % 7), "c_acctbal", "y", ["c_nationkey"])
    return d.select("c_nationkey", num(F.col("kendall")).alias("value"))


@query("corr_kendall_whole", "SELECT round(sum(sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(sum(CASE WHEN a.x <> b.x THEN 1 ELSE 0 END) * sum(CASE WHEN a.y <> b.y THEN 1.0 ELSE 0 END)), 6) + 0.0 AS value FROM (SELECT c_custkey, c_acctbal AS x, c_nationkey AS y FROM customer) a JOIN (SELECT c_custkey, c_acctbal AS x, c_nationkey AS y FROM customer) b ON a.c_custkey < b.c_custkey")
def _kendall_whole(t: Tables):
    return stats.kendall_scan(t.customer, "c_acctbal", "c_nationkey").select(num(F.col("kendall")).alias("value"))


@query("linear_regression", f"SELECT l_returnflag, {sql_num('regr_slope(l_extendedprice, l_quantity)', 4)} AS slope, {sql_num('regr_intercept(l_extendedprice, l_quantity)', 2)} AS intercept, {sql_num('(regr_syy(l_extendedprice, l_quantity) - regr_slope(l_extendedprice, l_quantity) * regr_sxy(l_extendedprice, l_quantity)) / (count(*) - 2) / 1e6', 4)} AS mse FROM {_LINE}")
def _regression(t: Tables):
    r = t.lineitem.groupBy("l_returnflag").agg(*stats.linear_regression(F.col("l_quantity"), F.col("l_extendedprice")))
    return r.select("l_returnflag", num(F.col("slope"), 4).alias("slope"), num(F.col("intercept"), 2).alias("intercept"), num(F.col("mse") / 1e6, 4).alias("mse"))


@query("dot_product", f"SELECT l_returnflag, {sql_num('sum(l_quantity * l_discount)', 4)} AS dot, {sql_num('sqrt(sum((l_quantity - l_tax) * (l_quantity - l_tax)))', 4)} AS distance, {sql_num('sum((l_quantity - l_tax) * (l_quantity - l_tax))', 2)} AS squared FROM {_LINE}")
def _dot(t: Tables):
    q, d, x = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    return t.lineitem.groupBy("l_returnflag").agg(num(stats.dot_product(q, d), 4).alias("dot"), num(stats.distance(q, x), 4).alias("distance"), num(stats.distance_squared(q, x), 2).alias("squared"))


@query("vector_equals", "SELECT l_returnflag, sqrt(sum(l_tax * l_tax)) < 0.001 AS taxed, true AS same FROM lineitem GROUP BY l_returnflag")
def _equals(t: Tables):
    q = F.col("l_quantity")
    return t.lineitem.groupBy("l_returnflag").agg(stats.equals(q, q - F.col("l_tax")).alias("taxed"), stats.equals(q, q).alias("same"))


@query("normalize", "SELECT event_id, round(value / sqrt(sum(value * value) OVER (PARTITION BY user_id)), 6) + 0.0 AS value FROM events")
def _normalize(t: Tables):
    return stats.normalize(t.events, "value", ["user_id"]).select("event_id", num(F.col("normalized")).alias("value"))


@query("staged_reduction", "SELECT user_id, round(max(value) - min(value), 6) + 0.0 AS width FROM events GROUP BY user_id")
def _staged(t: Tables):
    import pandas as pd

    step = lambda s: pd.DataFrame({"lo": [s.min()], "hi": [s.max()]})
    merge = lambda d: [d["hi"].max() - d["lo"].min()]
    out = stats.staged(t.events, ["user_id"], "value", step, merge, "lo double, hi double", "width double")
    return out.select("user_id", num(F.col("width")).alias("width"))


@query("ordered_check", "SELECT user_id, bool_and(ok) AS ordered FROM (SELECT user_id, coalesce(value >= lag(value) OVER (PARTITION BY user_id ORDER BY ts), true) AS ok FROM events) GROUP BY user_id")
def _is_ordered(t: Tables):
    return argops.is_ordered(t.events, "value", "ts", ["user_id"])
