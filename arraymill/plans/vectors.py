"""Queries for index-space, rolling, cumulative and filter operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from arraymill.operators import argops, convolve, prefix, rolling

from ._registry import Tables, num, num_scaled, query, sql_num

_W = "OVER (PARTITION BY user_id ORDER BY ts)"
_ALL = "OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
_AT = f"(row_number() {_W} - 1)"


@query("argsort", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS BIGINT) AS pos FROM orders")
def _argsort(t: Tables):
    return argops.argsort(t.orders, "o_totalprice", "o_orderkey")


@query("argsort_descending", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS BIGINT) AS pos FROM orders")
def _argsort_desc(t: Tables):
    return argops.argsort(t.orders, "o_totalprice", "o_orderkey", descending=True)


@query("argsort_grouped", "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) - 1 AS BIGINT) AS pos FROM events")
def _argsort_by(t: Tables):
    return argops.argsort(t.events, "value", "event_id", ["user_id"])


@query("argsort_nan_first", "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_type <> 'error', CASE WHEN event_type <> 'error' THEN value END, event_id) - 1 AS BIGINT) AS pos FROM events")
def _argsort_nan(t: Tables):
    v = t.events.withColumn("v", F.when(F.col("event_type") == "error", float("nan")).otherwise(F.col("value")))
    return argops.argsort(v, "v", "event_id", ["user_id"], nan="first").select("event_id", "pos")


@query("arg_min_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25")
def _arg_min_n(t: Tables):
    return argops.arg_min_n(t.orders, 25, "o_totalprice", "o_orderkey")


@query("argmin_argmax", "SELECT user_id, arg_min(event_id, (value, event_id)) AS least, arg_max(event_id, (value, -event_id)) AS most FROM events GROUP BY user_id")
def _argmin(t: Tables):
    v, i = F.col("value"), F.col("event_id")
    return t.events.groupBy("user_id").agg(argops.argmin(v, i).alias("least"), argops.argmax(v, i).alias("most"))


@query("arglast_every", "SELECT user_id, arg_max(event_id, (value, -event_id)) AS idx FROM events GROUP BY user_id")
def _arglast(t: Tables):
    return argops.arglast_every(t.events, "value", "event_id", ["user_id"])


@query("index_of", "SELECT user_id, CAST(coalesce(min(CASE WHEN event_type = 'error' THEN event_id END), 1000000) AS BIGINT) AS first, CAST(coalesce(max(CASE WHEN event_type = 'error' THEN event_id END), -1) AS BIGINT) AS last FROM events GROUP BY user_id")
def _index_of(t: Tables):
    hit = F.col("event_type") == "error"
    return t.events.groupBy("user_id").agg(argops.index_of(hit, F.col("event_id"), 1_000_000).alias("first"), argops.last_index_of(hit, F.col("event_id")).alias("last"))


@query("binary_search", "SELECT CAST(count(CASE WHEN o_totalprice < 200000 THEN 1 END) AS BIGINT) AS pos FROM orders")
def _search(t: Tables):
    return t.orders.agg(argops.binary_search(F.col("o_totalprice"), F.lit(200000)).alias("pos"))


@query("binary_search_many", "SELECT c_custkey, CAST((SELECT count(*) FROM orders WHERE o_totalprice < c_acctbal * 20) AS BIGINT) AS pos FROM customer")
def _search_many(t: Tables):
    targets = t.customer.select("c_custkey", (F.col("c_acctbal") * 20).alias("t"))
    return argops.search_many(t.orders, "o_totalprice", targets, "t").select("c_custkey", "pos")


@query("asof_join", "SELECT a.event_id, b.value AS prior FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.ts >= b.ts")
def _asof(t: Tables):
    left = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = t.events.where("event_type = 'view'").select("user_id", "ts", F.col("value").alias("prior"))
    return argops.asof(left, right, "ts", "prior", ["user_id"]).select("event_id", "prior")


@query("argfilter", "SELECT event_id FROM events WHERE value > 100")
def _argfilter(t: Tables):
    return argops.argfilter(t.events, lambda x: x > 100, "value", "event_id")


@query("binary_argfilter", "SELECT o_orderkey FROM orders WHERE o_totalprice > o_custkey * 100")
def _binary_argfilter(t: Tables):
    a = t.orders.select("o_orderkey", F.col("o_totalprice").alias("v"))
    b = t.orders.select("o_orderkey", (F.col("o_custkey") * 100.0).alias("v"))
    return argops.binary_argfilter(a, b, "gt", "v", "o_orderkey")


@query("indexes_where", "SELECT event_id FROM events WHERE event_type = 'click'")
def _indexes(t: Tables):
    return argops.indexes_where(t.events.withColumn("f", F.col("event_type") == "click"), "f", "event_id")


@query("arggroup", "SELECT event_type AS key, min(event_id) AS first, len(list(event_id)) AS n, md5(array_to_string(list_sort(list(event_id)), ',')) AS digest FROM events GROUP BY event_type")
def _arggroup(t: Tables):
    g = argops.arggroup(t.events, "event_type", "event_id")
    return g.select("key", "first", F.size("indexes").cast("bigint").alias("n"), F.md5(F.array_join(F.col("indexes").cast("array<string>"), ",")).alias("digest"))


@query("arggroup_by", "SELECT CAST(event_id % 7 AS BIGINT) AS key, min(event_id) AS first, len(list(event_id)) AS n FROM events GROUP BY event_id % 7")
def _arggroup_by(t: Tables):
    g = argops.arggroup(t.events, F.col("event_id") % 7, "event_id")
    return g.select("key", "first", F.size("indexes").cast("bigint").alias("n"))


_RUNS = f"SELECT *, sum(new) {_W} - 1 AS run FROM (SELECT *, CASE WHEN lag(event_type) {_W} IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS new FROM events)"


@query("argpartition", f"SELECT user_id, CAST(run AS BIGINT) AS run, CAST(count(*) AS BIGINT) AS n, min(epoch_us(ts)) AS first, any_value(event_type) AS value FROM ({_RUNS}) GROUP BY user_id, run")
def _argpartition(t: Tables):
    r = argops.argpartition(t.events, "event_type", "ts", ["user_id"])
    return r.select("user_id", "run", "n", F.unix_micros(F.col("first").cast("timestamp")).alias("first"), "value")


@query("argpartition_whole", "SELECT CAST(run AS BIGINT) AS run, CAST(count(*) AS BIGINT) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last, any_value(o_orderstatus) AS value FROM (SELECT *, sum(new) OVER (ORDER BY o_orderkey) - 1 AS run FROM (SELECT *, CASE WHEN lag(o_orderstatus) OVER (ORDER BY o_orderkey) IS DISTINCT FROM o_orderstatus THEN 1 ELSE 0 END AS new FROM orders)) GROUP BY run")
def _argpartition_whole(t: Tables):
    return argops.argpartition(t.orders, "o_orderstatus", "o_orderkey", [])


@query("arggroup_rows", "SELECT event_type AS key, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS BIGINT) AS pos, event_id FROM events")
def _arggroup_rows(t: Tables):
    return argops.arggroup_rows(t.events, "event_type", "event_id")


@query("argpartition_by", f"SELECT user_id, CAST(count(*) AS BIGINT) AS runs FROM (SELECT DISTINCT user_id, run FROM (SELECT *, sum(new) {_W} AS run FROM (SELECT *, CASE WHEN lag(value > 50) {_W} IS DISTINCT FROM (value > 50) THEN 1 ELSE 0 END AS new FROM events))) GROUP BY user_id")
def _argpartition_by(t: Tables):
    return argops.argpartition(t.events, F.col("value") > 50, "ts", ["user_id"]).groupBy("user_id").agg(F.count("*").alias("runs"))


@query("argshuffle", "SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS pos, true AS once, true AS moved FROM orders")
def _argshuffle(t: Tables):
    """Every position once, and few indexes left where they were."""
    done = argops.argshuffle(t.orders, "o_orderkey", 5)
    least = done.groupBy("pos").agg(F.count("*").alias("n"))
    stays = argops.argshuffle(t.orders, "o_orderkey", 5).join(prefix.row_numbers(t.orders.select("o_orderkey"), ["o_orderkey"]), "o_orderkey").agg(F.avg((F.col("pos") == F.col("idx")).cast("int")).alias("share"), F.count_distinct("o_orderkey").alias("all"))
    both = least.crossJoin(F.broadcast(stays))  # one row
    return both.select("pos", (F.col("n") == 1).alias("once"), ((F.col("share") < 0.05) & (F.col("all") == t.orders.count())).alias("moved"))


@query("row_positions", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS idx FROM orders")
def _positions(t: Tables):
    return prefix.row_numbers(t.orders.select("o_orderkey"), ["o_orderkey"])


# rolling windows with padding


def _pads(size: int, position: str) -> tuple[str, str, str]:
    lo, hi = rolling.offsets(size, position)
    frame = f"OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN {-lo} PRECEDING AND {hi} FOLLOWING)"
    return frame, f"greatest({-lo} - {_AT}, 0)", f"greatest({_AT} + {hi} - (count(*) {_ALL} - 1), 0)"


def _rolling(position: str, edge: str, f: str) -> None:
    frame, left, right = _pads(5, position)
    ends = f"{left} * first_value(value) {_ALL} + {right} * last_value(value) {_ALL}" if edge == "clamp" else "0"
    total = f"sum(value) {frame} + {ends}"
    inner = f"{f}(value) {frame}"
    sql = {"sum": total, "mean": f"({total}) / 5"}.get(f) or (inner if edge == "clamp" else f"CASE WHEN {left} + {right} > 0 THEN {'least' if f == 'min' else 'greatest'}({inner}, 0) ELSE {inner} END")

    @query(f"rolling_{f}_{position}_{edge}", f"SELECT event_id, {sql_num(f'({sql})')} AS value FROM events")
    def run(t: Tables):
        return rolling.fixed(t.events, "value", ["user_id"], "ts", 5, f, position, edge).select("event_id", num(F.col("rolled")).alias("value"))


for _p in ("left", "center", "right"):
    for _e in ("clamp", "zero"):
        for _f in ("sum", "mean", "min", "max"):
            _rolling(_p, _e, _f)

_f5, _l5, _r5 = _pads(5, "center")


@query("rolling_function", f"SELECT event_id, round(list_reduce(list_transform(w, lambda x: x * x), lambda a, b: a + b), 4) + 0.0 AS value FROM (SELECT event_id, list_concat(list_concat(list_transform(range(CAST({_l5} AS BIGINT)), lambda i: first_value), w), list_transform(range(CAST({_r5} AS BIGINT)), lambda i: last_value)) AS w FROM (SELECT *, first_value(value) {_ALL} AS first_value, last_value(value) {_ALL} AS last_value, list(value) {_f5} AS w FROM events))")
def _rolling_any(t: Tables):
    f = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)
    return rolling.fixed(t.events, "value", ["user_id"], "ts", 5, f).select("event_id", num(F.col("rolled"), 4).alias("value"))


@query("rolling_ranges", f"SELECT event_id, CAST(greatest({_AT} - 2, 0) AS BIGINT) AS first, CAST(least({_AT} + 3, count(*) {_ALL}) AS BIGINT) AS past FROM events")
def _ranges(t: Tables):
    return rolling.ranges(t.events, ["user_id"], "ts", 5).select("event_id", "first", "past")


for _p, _frame in {"right": "CURRENT ROW AND 3599 FOLLOWING", "left": "3599 PRECEDING AND CURRENT ROW", "center": "1800 PRECEDING AND 1799 FOLLOWING"}.items():

    @query(f"rolling_variable_{_p}", f"SELECT event_id, CAST(count(*) OVER w AS BIGINT) AS n, {sql_num('sum(value) OVER w')} AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) // 60000000 RANGE BETWEEN {_frame})")
    def _variable(t: Tables, position: str = _p):
        minute = F.call_function("div", F.unix_micros(F.col("ts").cast("timestamp")), F.lit(60_000_000))
        d = rolling.variable(t.events, ["user_id"], minute, 3600, {"n": lambda: F.count("*"), "total": lambda: F.sum("value")}, position)
        return d.select("event_id", "n", num(F.col("total")).alias("total"))


for _p, _cond in {"right": "o.value >= e.value", "left": "o.value <= e.value"}.items():
    _near = f"FILTER (WHERE abs(o.value - e.value) < 7.255 AND {_cond})"

    @query(f"rolling_variable_double_{_p}", f"SELECT event_id, CAST(count(*) {_near} AS BIGINT) AS n, {sql_num(f'sum(o.value) {_near}', 4)} AS total FROM events e JOIN (SELECT user_id, value FROM events) o USING (user_id) GROUP BY event_id")
    def _variable_double(t: Tables, position: str = _p):
        d = rolling.variable(t.events, ["user_id"], F.col("value"), 7.255, {"n": "count(*)", "total": "sum(value)"}, position)
        return d.select("event_id", "n", num(F.col("total"), 4).alias("total"))


_STEPS = """WITH RECURSIVE e AS (SELECT user_id, value, {at} AS v, row_number() OVER (PARTITION BY user_id ORDER BY {by}) - 1 AS i FROM events),
w AS (SELECT user_id, i, v FROM e WHERE i = 0 UNION ALL
  SELECT w.user_id, n.i, n.v FROM w, LATERAL (SELECT e.i, e.v FROM e WHERE e.user_id = w.user_id AND e.i > w.i AND e.v >= w.v + {step} ORDER BY e.i LIMIT 1) n)
SELECT w.user_id, CAST(w.i AS BIGINT) AS first, CAST(max(e.i) + 1 AS BIGINT) AS past, round(sum(e.value), 4) + 0.0 AS total FROM w JOIN e ON e.user_id = w.user_id AND e.i >= w.i AND e.v < w.v + {span} GROUP BY w.user_id, w.i"""


@query("rolling_variable_steps", _STEPS.format(at="value", by="value, event_id", step="20.5", span="33.25"))
def _variable_steps(t: Tables):
    d = rolling.variable_steps(t.events.select("user_id", "value"), ["user_id"], "value", 33.25, 20.5, {"total": F.sum("value")})
    return d.withColumn("total", num(F.col("total"), 4))


@query("rolling_calendar_days", _STEPS.format(at="ts", by="ts", step="INTERVAL 3 DAY", span="INTERVAL 7 DAY"))
def _variable_days(t: Tables):
    d = rolling.variable_steps(t.events.select("user_id", "value", "ts"), ["user_id"], "ts", 7, 3, {"total": F.sum("value")}, "days")
    return d.withColumn("total", num(F.col("total"), 4))


@query("rolling_calendar_months", _STEPS.format(at="ts", by="ts", step="INTERVAL 1 MONTH", span="INTERVAL 1 MONTH"))
def _variable_months(t: Tables):
    d = rolling.variable_steps(t.events.select("user_id", "value", "ts"), ["user_id"], "ts", 1, 1, {"total": F.sum("value")}, "months")
    return d.withColumn("total", num(F.col("total"), 4))


@query("expanding_windows", f"SELECT event_id, {sql_num(f'avg(value) {_W} / 3.14159265358979')} AS value FROM events")
def _expanding(t: Tables):
    return rolling.expanding(t.events, ["user_id"], "ts", {"m": F.avg("value")}).select("event_id", num(F.col("m") / 3.14159265358979).alias("value"))


_CUM = {"cumsum": f"sum(value) {_W}", "cummin": f"min(value) {_W}", "cummax": f"max(value) {_W}"}


def _cum(name: str, sql: str) -> None:
    @query(name, f"SELECT event_id, {sql_num(sql)} AS value FROM events")
    def run(t: Tables):
        return getattr(rolling, name)(t.events, "value", ["user_id"], "ts").select("event_id", num(F.col("run")).alias("value"))


for _n, _sql in _CUM.items():
    _cum(_n, _sql)


@query("cumprod", f"SELECT event_id, {sql_num(f'product(1 + value / 10000) {_W}')} AS value FROM events")
def _cumprod(t: Tables):
    d = t.events.withColumn("v", 1 + F.col("value") / 10000)
    return rolling.cumprod(d, "v", ["user_id"], "ts").select("event_id", num(F.col("run")).alias("value"))


_O = "OVER (ORDER BY o_orderkey)"
_OALL = "OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
_OAT = f"(row_number() {_O} - 1)"
_P = "o_totalprice"
#: One vector without keys: name, what to run, the column of its result, its SQL.
_WHOLE = {
    "rolling_mean_whole": (lambda d: rolling.fixed(d, _P, [], "o_orderkey", 5), "rolled", f"(sum({_P}) OVER (ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) + greatest(2 - {_OAT}, 0) * first_value({_P}) {_OALL} + greatest({_OAT} + 2 - (count(*) {_OALL} - 1), 0) * last_value({_P}) {_OALL}) / 5"),
    "rolling_max_whole": (lambda d: rolling.fixed(d, _P, [], "o_orderkey", 4, "max", "right"), "rolled", f"max({_P}) OVER (ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)"),
    "rolling_function_whole": (lambda d: rolling.fixed(d, _P, [], "o_orderkey", 3, lambda a: F.element_at(F.sort_array(a), 2), "left"), "rolled", f"list_sort([coalesce(lag({_P}, 2) {_O}, first_value({_P}) {_OALL}), coalesce(lag({_P}) {_O}, first_value({_P}) {_OALL}), {_P}])[2]"),
    "shift_whole": (lambda d: rolling.shift(d, _P, [], "o_orderkey", 3), "shifted", f"coalesce(lag({_P}, 3) {_O}, first_value({_P}) {_OALL})"),
    "shift_forward_whole": (lambda d: rolling.shift(d, _P, [], "o_orderkey", -2), "shifted", f"coalesce(lead({_P}, 2) {_O}, last_value({_P}) {_OALL})"),
    "gradient1d_whole": (lambda d: rolling.gradient1d(d, _P, [], "o_orderkey", 2.0), "gradient", f"(coalesce(lead({_P}) {_O}, {_P}) - coalesce(lag({_P}) {_O}, {_P})) / (CASE WHEN lead({_P}) {_O} IS NOT NULL AND lag({_P}) {_O} IS NOT NULL THEN 2 ELSE 1 END * 2.0)"),
    "diff1d_whole": (lambda d: rolling.diff1d(d, _P, [], "o_orderkey"), "diff", f"{_P} - lag({_P}) {_O}"),
    "cummin_whole": (lambda d: rolling.cummin(d, _P, [], "o_orderkey"), "run", f"min({_P}) {_O}"),
    "cummax_whole": (lambda d: rolling.cummax(d, _P, [], "o_orderkey"), "run", f"max({_P}) {_O}"),
    "cumprod_whole": (lambda d: rolling.cumprod(d.withColumn(_P, 1 + (F.col(_P) - 150000) / 1e9), _P, [], "o_orderkey"), "run", f"exp(sum(ln(1 + ({_P} - 150000) / 1e9)) {_O})"),
}


def _whole(name: str, f, column: str, sql: str) -> None:
    @query(name, f"SELECT o_orderkey, {sql_num('value', 4)} AS value FROM (SELECT o_orderkey, {sql} AS value FROM orders) WHERE value IS NOT NULL")
    def run(t: Tables):
        rounded = num_scaled if name == "cumprod_whole" else num
        return f(t.orders.select("o_orderkey", _P)).where(F.col(column).isNotNull()).select("o_orderkey", rounded(F.col(column), 4).alias("value"))


for _n, (_f, _c, _sql) in _WHOLE.items():
    _whole(_n, _f, _c, _sql)


@query("rolling_ranges_whole", f"SELECT o_orderkey, CAST(greatest({_OAT} - 2, 0) AS BIGINT) AS first, CAST(least({_OAT} + 3, count(*) {_OALL}) AS BIGINT) AS past FROM orders")
def _ranges_whole(t: Tables):
    return rolling.ranges(t.orders.select("o_orderkey"), [], "o_orderkey", 5)


@query("fill_range_whole", "SELECT round(v + CASE WHEN k = 0 THEN 0 ELSE (nxt - v) * k / parts END, 6) + 0.0 AS v, k > 0 AS inserted FROM (SELECT *, unnest(range(parts)) AS k FROM (SELECT *, CAST(CASE WHEN nxt - v > 3 THEN ceil((nxt - v) / 3) ELSE 1 END AS BIGINT) AS parts FROM (SELECT c_acctbal AS v, lead(c_acctbal) OVER (ORDER BY c_acctbal) AS nxt FROM customer)))")
def _fill_whole(t: Tables):
    d = rolling.fill_range(t.customer.select(F.col("c_acctbal").alias("v")), "v", [], 3.0)
    return d.select(num(F.col("v")).alias("v"), "inserted")


@query("downsample_whole", "SELECT CAST(d.pos AS BIGINT) AS pos, o_totalprice FROM range(100) d(pos) JOIN (SELECT o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) ON i = floor(0.5 + pos * ((SELECT count(*) FROM orders) - 1) / 99.0)")
def _downsample_whole(t: Tables):
    return rolling.downsample(t.orders, _P, [], "o_orderkey", 100)


@query("cumsum_whole", "SELECT o_orderkey, round(sum(o_totalprice) OVER (ORDER BY o_orderkey), 2) + 0.0 AS value FROM orders")
def _cumsum_whole(t: Tables):
    return prefix.running_total(t.orders.select("o_orderkey", "o_totalprice"), ["o_orderkey"], "o_totalprice", "run").select("o_orderkey", num(F.col("run"), 2).alias("value"))


for _k in (2, -3):
    _shifted = f"coalesce(lag(value, {_k}) {_W}, first_value(value) {_ALL})" if _k > 0 else f"coalesce(lead(value, {-_k}) {_W}, last_value(value) {_ALL})"

    @query(f"shift_{'back' if _k > 0 else 'forward'}", f"SELECT event_id, {_shifted} AS value FROM events")
    def _shift(t: Tables, k: int = _k):
        return rolling.shift(t.events, "value", ["user_id"], "ts", k).select("event_id", F.col("shifted").alias("value"))


@query("fill_range", "SELECT user_id, round(v + CASE WHEN k = 0 THEN 0 ELSE (nxt - v) * k / parts END, 6) + 0.0 AS v, k > 0 AS inserted FROM (SELECT *, unnest(range(parts)) AS k FROM (SELECT *, CAST(CASE WHEN nxt - v > 20 THEN ceil((nxt - v) / 20) ELSE 1 END AS BIGINT) AS parts FROM (SELECT user_id, value AS v, lead(value) OVER (PARTITION BY user_id ORDER BY value) AS nxt FROM events)))")
def _fill(t: Tables):
    d = rolling.fill_range(t.events.select("user_id", F.col("value").alias("v")), "v", ["user_id"], 20.0)
    return d.select("user_id", num(F.col("v")).alias("v"), "inserted")


@query("gradient1d", f"SELECT event_id, {sql_num(f'(coalesce(lead(value) {_W}, value) - coalesce(lag(value) {_W}, value)) / (CASE WHEN lead(value) {_W} IS NOT NULL AND lag(value) {_W} IS NOT NULL THEN 2 ELSE 1 END * 0.5)')} AS value FROM events")
def _gradient(t: Tables):
    return rolling.gradient1d(t.events, "value", ["user_id"], "ts", 0.5).select("event_id", num(F.col("gradient")).alias("value"))


@query("diff1d", f"SELECT * FROM (SELECT event_id, {sql_num(f'value - lag(value) {_W}')} AS value FROM events) WHERE value IS NOT NULL")
def _diff(t: Tables):
    return rolling.diff1d(t.events, "value", ["user_id"], "ts").select("event_id", num(F.col("diff")).alias("value"))


@query("diff1d_prepend", f"SELECT event_id, {sql_num(f'value - coalesce(lag(value) {_W}, 1.5)')} AS value FROM events")
def _diff_prepend(t: Tables):
    return rolling.diff1d(t.events, "value", ["user_id"], "ts", prepend=1.5).select("event_id", num(F.col("diff")).alias("value"))


@query("diff1d_append", f"SELECT event_id, {sql_num(f'coalesce(lead(value) {_W}, 1.5) - value')} AS value FROM events")
def _diff_append(t: Tables):
    return rolling.diff1d(t.events, "value", ["user_id"], "ts", append=1.5).select("event_id", num(F.col("diff")).alias("value"))


@query("downsample_nearest", f"SELECT user_id, CAST(pos AS BIGINT) AS pos, value FROM (SELECT DISTINCT user_id, n, unnest(range(8)) AS pos FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)) d JOIN (SELECT user_id, value, {_AT} AS i FROM events) e USING (user_id) WHERE e.i = floor(0.5 + d.pos * (d.n - 1) / 7.0)")
def _downsample(t: Tables):
    return rolling.downsample(t.events, "value", ["user_id"], "ts", 8)


@query("downsample_blocks", f"SELECT d.user_id, CAST(pos AS BIGINT) AS pos, round(avg(value), 6) + 0.0 AS value FROM (SELECT user_id, m, n, unnest(range(m)) AS pos FROM (SELECT user_id, least(7, count(*)) AS m, count(*) AS n FROM events GROUP BY user_id)) d JOIN (SELECT user_id, value, {_AT} AS i FROM events) e ON e.user_id = d.user_id AND i >= floor(pos * (n / m) + 0.5) AND i < floor(pos * (n / m) + 0.5) + floor(n / m + 0.5) GROUP BY d.user_id, pos")
def _blocks(t: Tables):
    return rolling.downsample_blocks(t.events, "value", ["user_id"], "ts", 7).withColumn("value", num(F.col("value")))


# filters

_K3 = [0.25, 0.5, 0.25]


def _padded_sum(kernel: list[float], left: int, edge: str) -> str:
    def at(d: int) -> str:
        got = "value" if d == 0 else f"lag(value, {-d}) {_W}" if d < 0 else f"lead(value, {d}) {_W}"
        stand = "0" if edge == "zero" else f"first_value(value) {_ALL}" if d < 0 else f"last_value(value) {_ALL}"
        return f"coalesce({got}, {stand})"

    return " + ".join(f"{at(k - left)} * {w!r}" for k, w in enumerate(kernel))


for _e in ("zero", "clamp"):

    @query(f"correlate_same_{_e}", f"SELECT event_id, {sql_num('(' + _padded_sum([0.2, 0.5, 0.3], 1, _e) + ')')} AS value FROM events")
    def _same(t: Tables, edge: str = _e):
        return convolve.same(t.events, "value", ["user_id"], "ts", [0.2, 0.5, 0.3], edge).select("event_id", num(F.col("filtered")).alias("value"))


@query("convolve_same", f"SELECT user_id, CAST({_AT} AS BIGINT) AS pos, {sql_num('(' + _padded_sum([0.3, 0.5, 0.2], 1, 'zero') + ')')} AS value FROM events")
def _convolve(t: Tables):
    return convolve.convolve1d(t.events, "value", ["user_id"], "ts", [0.2, 0.5, 0.3], mode="same").withColumn("value", num(F.col("value")))


@query("convolve_fft", f"SELECT user_id, CAST({_AT} AS BIGINT) AS pos, {sql_num('(' + _padded_sum([0.3, 0.5, 0.2], 1, 'zero') + ')')} AS value FROM events")
def _convolve_fft(t: Tables):
    return convolve.convolve1d(t.events, "value", ["user_id"], "ts", [0.2, 0.5, 0.3], mode="same", fft=True).withColumn("value", num(F.col("value")))


@query("correlate_valid", f"SELECT user_id, CAST(pos AS BIGINT) AS pos, {sql_num('value')} AS value FROM (SELECT user_id, {_AT} AS pos, value * 0.2 + lead(value, 1) {_W} * 0.5 + lead(value, 2) {_W} * 0.3 AS value FROM events) WHERE value IS NOT NULL")
def _valid(t: Tables):
    return convolve.correlate1d(t.events, "value", ["user_id"], "ts", [0.2, 0.5, 0.3], mode="valid").withColumn("value", num(F.col("value")))


@query("correlate_full", f"SELECT user_id, CAST(pos AS BIGINT) AS pos, {sql_num('sum(part)')} AS value FROM (SELECT user_id, i + 2 - k AS pos, value * [0.2, 0.5, 0.3][k + 1] AS part FROM (SELECT user_id, value, {_AT} AS i FROM events), range(3) r(k)) GROUP BY user_id, pos")
def _full(t: Tables):
    return convolve.correlate1d(t.events, "value", ["user_id"], "ts", [0.2, 0.5, 0.3], mode="full").withColumn("value", num(F.col("value")))


_G = convolve.gauss_kernel(0.6, 2)


@query("gaussian1d", f"SELECT user_id, CAST({_AT} AS BIGINT) AS pos, {sql_num('(' + _padded_sum(_G, 2, 'clamp') + ')')} AS value FROM events")
def _gaussian(t: Tables):
    return convolve.gaussian1d(t.events, "value", ["user_id"], "ts", 0.6, edge="nearest").withColumn("value", num(F.col("value")))


@query("gauss_kernel", f"SELECT CAST(i AS BIGINT) AS i, round(exp(-(i - 3) * (i - 3) / 4.5) / (SELECT sum(exp(-(j - 3) * (j - 3) / 4.5)) FROM range(7) q(j)), 9) AS w FROM range(7) r(i)")
def _kernel(t: Tables):
    return t.spark.createDataFrame([(i, round(w, 9)) for i, w in enumerate(convolve.gauss_kernel(1.5, 3))], "i bigint, w double")


@query("ricker", "SELECT CAST(i AS BIGINT) AS i, round(2 / (sqrt(3 * 2.0) * pow(pi(), 0.25)) * (1 - pow((i - 4) / 2.0, 2)) * exp(-(i - 4) * (i - 4) / 8.0), 9) AS w FROM range(9) r(i)")
def _ricker(t: Tables):
    return t.spark.createDataFrame([(i, round(w, 9)) for i, w in enumerate(convolve.ricker(9, 2.0))], "i bigint, w double")


def _skewed(points: int, width: float) -> list[float]:
    """A wavelet that is not symmetric, so that a reversal shows."""
    return [(k + 1) / width for k in range(points)]


@query("cwt", f"SELECT user_id, width, CAST(i AS BIGINT) AS pos, {sql_num('sum(v * (k + 1) / width)', 4)} AS value FROM (SELECT a.user_id, width, a.i, k, b.value AS v FROM (SELECT user_id, {_AT} AS i, count(*) {_ALL} AS n FROM events) a, (VALUES (0.5), (1.0)) w(width), range(10) r(k) LEFT JOIN (SELECT user_id, value, {_AT} AS j FROM events) b ON b.user_id = a.user_id AND b.j = a.i + k - (CASE WHEN least(CAST(10 * width AS BIGINT), n) % 2 = 1 THEN least(CAST(10 * width AS BIGINT), n) // 2 ELSE least(CAST(10 * width AS BIGINT), n) // 2 - 1 END) WHERE k < least(CAST(10 * width AS BIGINT), n)) GROUP BY user_id, width, i")
def _cwt(t: Tables):
    d = convolve.cwt(t.events, "value", ["user_id"], "ts", [0.5, 1.0], _skewed)
    return d.withColumn("value", num(F.col("value"), 4))


def _long(t: Tables):
    return prefix.row_numbers(t.orders.select("o_orderkey", F.col(_P).alias("v")), ["o_orderkey"]).select("idx", "v")


_KL = [0.1, 0.4, 0.3, 0.15, 0.05]


def _long_sql(left: int, right: int, edge: str, kernel: list[float] = _KL, step: int = 1) -> str:
    """One long vector against a kernel, by a join with the places that it reaches."""
    m, n = len(kernel), "(SELECT count(*) FROM orders)"
    at = {"zero": "p", "constant": "p", "clamp": f"greatest(0, least(p, {n} - 1))", "wrap": f"((p + {n}) % {n})", "reflect": f"CASE WHEN p < 0 THEN -1 - p WHEN p >= {n} THEN 2 * {n} - 1 - p ELSE p END"}[edge]
    ks = ", ".join(f"({k}, {w!r})" for k, w in enumerate(kernel))
    return f"""WITH v AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, o_totalprice AS v FROM orders),
    r AS (SELECT o, w, o * {step} + k - {left} AS p FROM range((({n} + {left + right - m}) // {step}) + 1) q(o), (VALUES {ks}) kk(k, w))
    SELECT CAST(o AS BIGINT) AS idx, {sql_num(f'sum(w * coalesce(v, {7.5 if edge == "constant" else 0}))', 4)} AS value FROM (SELECT o, w, {at} AS i FROM r) LEFT JOIN v USING (i) GROUP BY o"""


_LONG = {
    "full_zero": ("full", "zero", {}), "full_constant": ("full", "constant", {"constant": 7.5}), "same_clamp": ("same", "clamp", {}), "same_reflect": ("same", "reflect", {}),
    "same_wrap": ("same", "wrap", {}), "valid": ("valid", "zero", {}), "fft": ("same", "reflect", {"fft": True}), "stepped": ("valid", "zero", {"step": 3}),
}
for _n, (_mode, _edge, _more) in _LONG.items():

    @query(f"correlate_long_{_n}", _long_sql(*convolve.pads(5, _mode), _edge, step=_more.get("step", 1)))
    def _correlate_long(t: Tables, mode: str = _mode, edge: str = _edge, more: dict = _more):
        return convolve.correlate_long(_long(t), "v", "idx", _KL, mode, edge, block=4096, **more).select("idx", num(F.col("filtered"), 4).alias("value"))


_GL = convolve.gauss_kernel(1.5, 6)


@query("gaussian_long", _long_sql(6, 6, "reflect", _GL))
def _gaussian_long(t: Tables):
    return convolve.gaussian_long(_long(t), "v", "idx", 1.5, block=4096).select("idx", num(F.col("filtered"), 4).alias("value"))


@query("cwt_long", "SELECT 0.5 AS width, * FROM (" + _long_sql(2, 2, "zero", _skewed(5, 0.5)) + ")")
def _cwt_long(t: Tables):
    d = convolve.cwt_long(_long(t), "v", "idx", [0.5], _skewed, block=4096)
    return d.withColumn("value", num(F.col("value"), 4))


@query("filter_long_vector", "SELECT CAST(o_orderkey AS BIGINT) AS idx, round(coalesce(lag(o_totalprice) OVER w, 0) * 0.25 + o_totalprice * 0.5 + coalesce(lead(o_totalprice) OVER w, 0) * 0.25, 4) + 0.0 AS value FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS o_orderkey, o_totalprice FROM orders) WINDOW w AS (ORDER BY o_orderkey)")
def _filter_long(t: Tables):
    v = prefix.row_numbers(t.orders.select("o_orderkey", "o_totalprice"), ["o_orderkey"]).select("idx", "o_totalprice")
    return convolve.same_long(v, "o_totalprice", "idx", _K3, block=4096).select("idx", num(F.col("filtered"), 4).alias("value"))
