"""Queries for containers, tensors, sets, records, images, sources and windows over streams."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from arraymill.operators import buffers, images, prefix, sets, tensor
from arraymill.sources import io
from arraymill.store import folder
from arraymill.streaming import windows

from ._registry import Tables, num, query, sql_num

_VEC = "(SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, o_totalprice AS v FROM orders)"
_N = "(SELECT count(*) FROM orders)"


def _vector(t: Tables):
    return prefix.row_numbers(t.orders.select("o_orderkey", F.col("o_totalprice").alias("v")), ["o_orderkey"]).select("idx", "v")


@query("buffer_container", "SELECT CAST(i AS BIGINT) AS idx, CAST(i * 3 AS BIGINT) AS v FROM range(50) r(i)")
def _container(t: Tables):
    return buffers.container(t.spark, "int16", [3 * i for i in range(50)]).withColumn("v", F.col("v").cast("bigint"))


@query("buffer_constant", "SELECT CAST(i AS BIGINT) AS idx, 7.5 AS v FROM range(100) r(i)")
def _constant(t: Tables):
    return buffers.constant(t.spark, 7.5, 100)


@query("buffer_reader", "SELECT CAST(i AS BIGINT) AS idx, CAST(i * i AS BIGINT) AS v FROM range(1000) r(i)")
def _reader(t: Tables):
    return buffers.reader(t.spark, 1000, lambda i: i * i)


@query("buffer_sub", f"SELECT CAST(idx - 100 AS BIGINT) AS idx, v FROM {_VEC} WHERE idx BETWEEN 100 AND 299")
def _sub(t: Tables):
    return buffers.sub_buffer(_vector(t), 100, 200)


@query("buffer_gather", f"SELECT CAST(p AS BIGINT) AS pos, v FROM range(2 * {_N}) r(p) JOIN {_VEC} q ON q.idx = (p * 7 + 3) % {_N}")
def _gather(t: Tables):
    n = t.orders.count()
    ix = t.spark.range(2 * n).select(F.col("id").alias("pos"), ((F.col("id") * 7 + 3) % n).alias("idx"))
    return buffers.gather(_vector(t), ix)


@query("buffer_concat", f"SELECT CAST(idx AS BIGINT) AS idx, v FROM {_VEC} UNION ALL SELECT CAST(2 * {_N} - 1 - idx AS BIGINT), v FROM {_VEC}")
def _concat(t: Tables):
    v, n = _vector(t), t.orders.count()
    return buffers.concatenated([(v, n), (buffers.reverse(v, n), n)])


@query("buffer_reverse", f"SELECT CAST({_N} - 1 - idx AS BIGINT) AS idx, v FROM {_VEC}")
def _reverse(t: Tables):
    v = _vector(t)
    return buffers.reverse(v, v.count())


@query("buffer_get_value", f"SELECT v FROM {_VEC} WHERE idx = 17")
def _get(t: Tables):
    return buffers.get_value(_vector(t), 17)


@query("buffer_set_value", f"SELECT CAST(idx AS BIGINT) AS idx, CASE WHEN idx = 5 THEN -1.0 ELSE v END AS v FROM {_VEC}")
def _set(t: Tables):
    return buffers.set_value(_vector(t), 5, -1.0)


@query("buffer_set_constant", f"SELECT CAST(idx AS BIGINT) AS idx, CASE WHEN idx BETWEEN 10 AND 29 THEN 0.0 ELSE v END AS v FROM {_VEC}")
def _set_constant(t: Tables):
    return buffers.set_constant(_vector(t), 10, 20, 0.0)


@query("buffer_update", f"SELECT CAST(idx AS BIGINT) AS idx, CASE WHEN idx % 10 = 0 THEN -v ELSE v END AS v FROM {_VEC}")
def _update(t: Tables):
    v = _vector(t)
    return buffers.updated(v, v.where("idx % 10 = 0").withColumn("v", -F.col("v")))


@query("buffer_coalesce", "SELECT CAST(row_number() OVER (ORDER BY vec_id, k) - 1 AS BIGINT) AS idx, CAST(e AS DOUBLE) AS v FROM (SELECT vec_id, unnest(embedding) AS e, unnest(range(len(embedding))) AS k FROM embeddings)")
def _flat(t: Tables):
    return buffers.coalesce(t.embeddings, "embedding", "vec_id").withColumn("v", F.col("v").cast("double"))


@query("buffer_without_nan", f"SELECT CAST(idx AS BIGINT) AS idx, v FROM {_VEC} WHERE idx % 3 <> 0")
def _without_nan(t: Tables):
    v = _vector(t).withColumn("v", F.when(F.col("idx") % 3 == 0, float("nan")).otherwise(F.col("v")))
    return buffers.without_nan(v)


@query("buffer_count", f"SELECT CAST({_N} AS BIGINT) AS n")
def _count(t: Tables):
    return buffers.count(_vector(t))


@query("emap", "SELECT o_orderkey, round(o_totalprice / (3.7 * (1 + o_custkey)), 6) + 0.0 AS value FROM orders")
def _emap(t: Tables):
    return buffers.emap(t.orders, lambda p, k: num(p / (3.7 * (1 + k))), "o_totalprice", "o_custkey").select("o_orderkey", "value")


@query("emap_opaque", "SELECT o_orderkey, round(o_totalprice * 2 + 1, 6) + 0.0 AS value FROM orders")
def _opaque(t: Tables):
    @pandas_udf("double")
    def twice(x: pd.Series) -> pd.Series:
        return x * 2 + 1

    return buffers.emap(t.orders, lambda p: num(twice(p)), "o_totalprice").select("o_orderkey", "value")


@query("zipped_vectors", f"SELECT CAST(a.idx AS BIGINT) AS idx, round(a.v - b.v, 6) + 0.0 AS v FROM {_VEC} a JOIN {_VEC} b ON b.idx = {_N} - 1 - a.idx")
def _zipped(t: Tables):
    v = _vector(t)
    return buffers.zipped(v, buffers.reverse(v, t.orders.count()), lambda a, b: num(a - b))


@query("opaque_map_reduce", "SELECT CAST(sum(i * i) AS BIGINT) AS value FROM range(100000) r(i)")
def _opaque_map_reduce(t: Tables):
    return sets.map_reduce_opaque(t.spark, 100_000, lambda i: int((i.astype("int64") ** 2).sum()), lambda a, b: a + b, "bigint")


@query("indexed_map_reduce", "SELECT CAST(sum(i * i) AS BIGINT) AS value FROM range(10000) r(i)")
def _map_reduce(t: Tables):
    return sets.map_reduce(t.spark, 10_000, lambda i: i * i, F.sum)


# tensors: the embeddings as a matrix, and small computed ones

_M = "(SELECT vec_id AS i0, k AS i1, CAST(e AS DOUBLE) AS v FROM (SELECT vec_id, unnest(embedding) AS e, unnest(range(len(embedding))) AS k FROM embeddings))"
_R = "(SELECT count(*) FROM embeddings)"
#: The embeddings as a tensor of rows x 8 x 8.
_C = f"(SELECT i0, i1 // 8 AS i1, i1 % 8 AS i2, v FROM {_M})"
_B = lambda *xs: ", ".join(f"CAST({x} AS BIGINT) AS i{k}" for k, x in enumerate(xs))


def _matrix(t: Tables) -> tensor.Tensor:
    m = tensor.from_cells(t.embeddings, "vec_id", "embedding", t.embeddings.count(), 64)
    return tensor.Tensor(m.df.withColumn("v", F.col("v").cast("double")), m.shape)


def _cube(t: Tables) -> tensor.Tensor:
    m = _matrix(t)
    return tensor.reshape(m, (m.shape[0], 8, 8))


_AT = "(i0 * 64 + i1 * 8 + i2)"
_TENSORS = {
    "reshape": (lambda x: tensor.reshape(x, (2 * x.shape[0], 32)), f"SELECT {_B(f'{_AT} // 32', f'{_AT} % 32')}, v FROM {_C}"),
    "reshape_smaller": (lambda x: tensor.reshape(x, (x.shape[0], 3)), f"SELECT {_B(f'{_AT} // 3', f'{_AT} % 3')}, v FROM {_C} WHERE {_AT} < 3 * {_R}"),
    "transpose": (lambda x: tensor.transpose(x, [2, 0, 1]), f"SELECT {_B('i2', 'i0', 'i1')}, v FROM {_C}"),
    "rotate": (lambda x: tensor.rotate(x, [1, 0, -2]), f"SELECT {_B(f'(i0 + {_R} - 1) % {_R}', 'i1', '(i2 + 2) % 8')}, v FROM {_C}"),
    "broadcast": (lambda x: tensor.broadcast(x, (2, x.shape[0], 16, 8)), f"SELECT {_B('a', 'i0', 'i1 + 8 * b', 'i2')}, v FROM {_C}, range(2) p(a), range(2) q(b)"),
    "select_number": (lambda x: tensor.select(x, "all", 2), f"SELECT {_B('i0', 'i2')}, v FROM {_C} WHERE i1 = 2"),
    "select_reverse": (lambda x: tensor.select(x, "reverse"), f"SELECT {_B(f'{_R} - 1 - i0', 'i1', 'i2')}, v FROM {_C}"),
    "select_range": (lambda x: tensor.select(x, "all", range(1, 4)), f"SELECT {_B('i0', 'i1 - 1', 'i2')}, v FROM {_C} WHERE i1 BETWEEN 1 AND 3"),
    "select_list": (lambda x: tensor.select(x, "all", "all", [5, 0, 5]), f"SELECT {_B('i0', 'i1', 'o')}, v FROM {_C} JOIN (VALUES (5, 0), (0, 1), (5, 2)) m(s, o) ON i2 = m.s"),
    "slice": (lambda x: tensor.at(x, 2), f"SELECT {_B('i1', 'i2')}, v FROM {_C} WHERE i0 = 2"),
    "slice_right": (lambda x: tensor.at_right(x, 4), f"SELECT {_B('i0', 'i1')}, v FROM {_C} WHERE i2 = 4"),
    "mget": (lambda x: tensor.mget(x, 1, 2), f"SELECT {_B('i2')}, v FROM {_C} WHERE i0 = 1 AND i1 = 2"),
    "mset": (lambda x: tensor.mset(x, -1.0, F.col("i1") == 3), f"SELECT {_B('i0', 'i1', 'i2')}, CASE WHEN i1 = 3 THEN -1.0 ELSE v END AS v FROM {_C}"),
    "assign": (lambda x: tensor.assign(x, x.df.where("i0 % 2 = 0").withColumn("v", F.lit(0.0))), f"SELECT {_B('i0', 'i1', 'i2')}, CASE WHEN i0 % 2 = 0 THEN 0.0 ELSE v END AS v FROM {_C}"),
    "assign_part": (lambda x: tensor.assign_at(x, tensor.constant(x.df.sparkSession, 7.0, (x.shape[0] - 3, 2, 3)), (3, 1, 4)), f"SELECT {_B('i0', 'i1', 'i2')}, CASE WHEN i0 >= 3 AND i1 BETWEEN 1 AND 2 AND i2 BETWEEN 4 AND 6 THEN 7.0 ELSE v END AS v FROM {_C}"),
    "reduce_axis": (lambda x: tensor.reduce_axis(x, F.max, 1), f"SELECT {_B('i0', 'i2')}, max(v) AS v FROM {_C} GROUP BY i0, i2"),
    "map_axis": (lambda x: tensor.map_axis(x, lambda w: F.max("v").over(w), 2), f"SELECT {_B('i0', 'i1', 'i2')}, max(v) OVER (PARTITION BY i0, i1 ORDER BY i2) AS v FROM {_C}"),
    "map_axis_vectors": (lambda x: tensor.map_vectors(x, lambda a: F.transform(F.reverse(a), lambda v: v * 2), 2), f"SELECT {_B('i0', 'i1', '7 - i2')}, v * 2 AS v FROM {_C}"),
    "zip_with": (lambda x: tensor.zip_with(x, tensor.select(x, 0), lambda a, b: a - b), f"SELECT {_B('a.i0', 'a.i1', 'a.i2')}, a.v - b.v AS v FROM {_C} a JOIN {_C} b ON b.i0 = 0 AND a.i1 = b.i1 AND a.i2 = b.i2"),
    "emap": (lambda x: tensor.emap(x, lambda v: v * 2), f"SELECT {_B('i0', 'i1', 'i2')}, v * 2 AS v FROM {_C}"),
    "compute": (lambda x: tensor.compute(x.df.sparkSession, x.shape, lambda i, j, k: (i * 100 + j * 10 + k).cast("double")), f"SELECT {_B('i0', 'i1', 'i2')}, CAST(i0 * 100 + i1 * 10 + i2 AS DOUBLE) AS v FROM {_C}"),
    "constant": (lambda x: tensor.constant(x.df.sparkSession, 3.0, x.shape), f"SELECT {_B('i0', 'i1', 'i2')}, CAST(3 AS DOUBLE) AS v FROM {_C}"),
    "zeros": (lambda x: tensor.zeros(x.df.sparkSession, x.shape), f"SELECT {_B('i0', 'i1', 'i2')}, CAST(0 AS DOUBLE) AS v FROM {_C}"),
    "from_nested": (lambda x: tensor.from_nested(x.df.sparkSession, [[1, 2], [3, 4], [5, 6]]), f"SELECT {_B('i', 'j')}, CAST(i * 2 + j + 1 AS DOUBLE) AS v FROM range(3) a(i), range(2) b(j)"),
}


def _tensor(name: str, f, sql: str) -> None:
    @query(f"tensor_{name}", sql)
    def run(t: Tables):
        return f(_cube(t)).df


for _n, (_f, _sql) in _TENSORS.items():
    _tensor(_n, _f, _sql)


@query("tensor_from_cells", f"SELECT {_B('i0', 'i1')}, v FROM {_M}")
def _from_cells(t: Tables):
    return _matrix(t).df


@query("tensor_reduce_rows", f"SELECT CAST(i1 AS BIGINT) AS i0, {sql_num('avg(v)')} AS v FROM {_M} GROUP BY i1")
def _column_means(t: Tables):
    return tensor.reduce_axis(_matrix(t), F.avg, 0).df.withColumn("v", num(F.col("v")))


@query("tensor_to_vector", f"SELECT CAST(i0 * 64 + i1 AS BIGINT) AS idx, v FROM {_M}")
def _to_vector(t: Tables):
    return tensor.to_vector(_matrix(t))


@query("tensor_from_vector", f"SELECT {_B('idx // 10', 'idx % 10')}, v FROM {_VEC}")
def _from_vector(t: Tables):
    return tensor.from_vector(_vector(t), "idx", "v", (-(-t.orders.count() // 10), 10)).df


_SUM = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


@query("tensor_rows", f"SELECT CAST(i0 AS BIGINT) AS i0, {sql_num('sum(v)')} AS total, CAST(count(*) AS BIGINT) AS n FROM {_C} GROUP BY i0")
def _rows(t: Tables):
    return tensor.rows(_cube(t)).select("i0", num(_SUM("v")).alias("total"), F.size("v").cast("bigint").alias("n"))


@query("tensor_columns", f"SELECT CAST(i2 AS BIGINT) AS i2, {sql_num('sum(v)', 4)} AS total FROM {_C} GROUP BY i2")
def _columns(t: Tables):
    return tensor.columns(_cube(t)).select("i2", num(_SUM("v"), 4).alias("total"))


@query("tensor_to_cells", f"SELECT CAST(i0 AS BIGINT) AS i0, CAST(i1 AS BIGINT) AS i1, {sql_num('sum(v * (i2 + 1))')} AS v FROM {_C} GROUP BY i0, i1")
def _to_cells(t: Tables):
    weighed = F.transform("v", lambda x, k: x * (k + 1))
    return tensor.to_cells(_cube(t)).withColumn("v", num(_SUM(weighed)))


@query("tensor_to_string", f"SELECT CAST(i0 AS BIGINT) AS i0, '[' || string_agg(line, ' ' ORDER BY i1) || ']' AS text FROM (SELECT i0, i1, '[' || string_agg(CAST(i0 * 100 + i1 * 10 + i2 AS VARCHAR), ' ' ORDER BY i2) || ']' AS line FROM {_C} GROUP BY i0, i1) GROUP BY i0")
def _to_string(t: Tables):
    x = _cube(t)
    return tensor.to_strings(tensor.compute(t.spark, x.shape, lambda i, j, k: i * 100 + j * 10 + k), 1).withColumnRenamed("v", "text")


@query("tensor_slices", f"SELECT CAST(i0 AS BIGINT) AS slice, {_B('i1', 'i2')}, v FROM {_C}")
def _slices(t: Tables):
    return tensor.slices(_cube(t), 1)


@query("tensor_matmul", f"SELECT CAST(a.i1 AS BIGINT) AS i0, CAST(b.i1 AS BIGINT) AS i1, {sql_num('sum(a.v * b.v)')} AS v FROM {_M} a JOIN {_M} b ON a.i0 = b.i0 GROUP BY a.i1, b.i1")
def _matmul(t: Tables):
    m = _matrix(t)
    return tensor.matmul(tensor.transpose(m, [1, 0]), m).df.withColumn("v", num(F.col("v")))


# sets

_A, _Z = "(SELECT DISTINCT user_id AS idx FROM events WHERE event_type = 'error')", "(SELECT DISTINCT user_id AS idx FROM events WHERE event_type = 'purchase' AND value > 40)"
_SETS = {
    "union": (sets.union, f"SELECT idx FROM {_A} UNION SELECT idx FROM {_Z}"),
    "intersection": (sets.intersection, f"SELECT idx FROM {_A} INTERSECT SELECT idx FROM {_Z}"),
    "difference": (sets.difference, f"SELECT idx FROM {_A} EXCEPT SELECT idx FROM {_Z}"),
    "xor": (sets.symmetric_difference, f"(SELECT idx FROM {_A} EXCEPT SELECT idx FROM {_Z}) UNION (SELECT idx FROM {_Z} EXCEPT SELECT idx FROM {_A})"),
    "reduce_union": (lambda a, b: sets.reduce_union([a, b]), f"SELECT idx FROM {_A} UNION SELECT idx FROM {_Z}"),
    "reduce_intersection": (lambda a, b: sets.reduce_intersection([a, b]), f"SELECT idx FROM {_A} INTERSECT SELECT idx FROM {_Z}"),
    "offset": (lambda a, b: sets.offset(a, 1000), f"SELECT idx + 1000 AS idx FROM {_A}"),
    "contains_range": (lambda a, b: sets.contains_range(a, 10, 20), f"SELECT count(*) = 10 AS holds FROM {_A} WHERE idx BETWEEN 10 AND 19"),
    "intersects_range": (lambda a, b: sets.intersects_range(a, 10, 20), f"SELECT count(*) > 0 AS holds FROM {_A} WHERE idx BETWEEN 10 AND 19"),
    "bounds": (lambda a, b: sets.bounds(a), f"SELECT min(idx) AS least, max(idx) AS most, max(idx) - min(idx) + 1 = count(*) AS contiguous FROM {_A}"),
    "to_map": (lambda a, b: sets.to_map(a, 1.5), f"SELECT idx, 1.5 AS value FROM {_A}"),
    "random_access": (lambda a, b: prefix.row_numbers(a, ["idx"], "pos"), f"SELECT idx, CAST(row_number() OVER (ORDER BY idx) - 1 AS BIGINT) AS pos FROM {_A}"),
}


def _set_query(name: str, f, sql: str) -> None:
    @query(f"bitmap_{name}", sql)
    def run(t: Tables):
        a = sets.index_set(t.events.where("event_type = 'error'"), "user_id")
        return f(a, sets.index_set(t.events.where("event_type = 'purchase' AND value > 40"), "user_id"))


for _n, (_f, _sql) in _SETS.items():
    _set_query(_n, _f, _sql)


@query("bitmap_distinct", "SELECT CAST(count(DISTINCT user_id) AS BIGINT) AS n FROM events")
def _bitmaps(t: Tables):
    return sets.bitmaps_union(sets.to_bitmaps(t.events, "user_id", ["event_type"]))


@query("range_make", "SELECT CAST(i AS BIGINT) AS idx FROM range(5, 500, 3) r(i)")
def _range(t: Tables):
    return sets.span(t.spark, 5, 500, 3)


@query("range_reverse", "SELECT CAST(i AS BIGINT) AS idx FROM range(100) r(i)")
def _reverse_range(t: Tables):
    return sets.reverse_span(t.spark, 100)


@query("reservoir_sample", "SELECT CAST(64 AS BIGINT) AS n, CAST(64 AS BIGINT) AS distinct_rows, CAST(64 AS BIGINT) AS from_table, true AS spread")
def _reservoir(t: Tables):
    """That the rows are 64 different ones of the table, and come from all of it."""
    some = sets.reservoir(t.orders.select("o_orderkey"), 64, 3, by="o_orderkey").join(t.orders.select("o_orderkey", F.lit(1).alias("own")), "o_orderkey", "left")
    middle = t.orders.agg(F.avg("o_orderkey").alias("m"))
    low = some.crossJoin(F.broadcast(middle)).agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("distinct_rows"), F.count("own").alias("from_table"), F.avg((F.col("o_orderkey") < F.col("m")).cast("int")).between(0.2, 0.8).alias("spread"))  # one row
    return low


@query("reservoir_sample_grouped", "SELECT user_id, CAST(least(5, count(*)) AS BIGINT) AS n FROM events GROUP BY user_id")
def _reservoir_by(t: Tables):
    return sets.reservoir(t.events, 5, 3, ["user_id"], "event_id").groupBy("user_id").agg(F.count("*").alias("n"))


@query("struct_columns", "SELECT c_custkey, c_acctbal AS x, CAST(c_nationkey AS BIGINT) AS y FROM customer")
def _structs(t: Tables):
    s = t.customer.select("c_custkey", sets.struct({"x": F.col("c_acctbal"), "y": F.col("c_nationkey").cast("bigint")}).alias("s"))
    return s.select("c_custkey", *sets.columns_of("s", ["x", "y"]))


@query("struct_array_columns", "SELECT c_nationkey, CAST(sum(c_custkey) AS BIGINT) AS total FROM customer GROUP BY c_nationkey")
def _struct_arrays(t: Tables):
    s = t.customer.groupBy("c_nationkey").agg(F.collect_list(sets.struct({"k": F.col("c_custkey"), "b": F.col("c_acctbal")})).alias("rows"))
    return s.select("c_nationkey", F.aggregate("rows.k", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


# images, binary data

_IMG = "(SELECT i AS y, j AS x, c, (i * 7 + j * 3 + c * 50) % 256 AS v FROM range(24) a(i), range(32) b(j), range(3) d(c))"


def _image(t: Tables) -> tensor.Tensor:
    return tensor.compute(t.spark, (24, 32, 3), lambda i, j, c: (i * 7 + j * 3 + c * 50) % 256)


@query("image_downsample", f"SELECT CAST(y // 2 AS BIGINT) AS i0, CAST(x // 2 AS BIGINT) AS i1, CAST(c AS BIGINT) AS i2, avg(v) AS v FROM {_IMG} GROUP BY ALL")
def _half(t: Tables):
    return images.downsample(_image(t)).df


@query("image_resize_nearest", f"SELECT CAST(i AS BIGINT) AS i0, CAST(j AS BIGINT) AS i1, CAST(c AS BIGINT) AS i2, CAST(v AS BIGINT) AS v FROM range(10) a(i), range(12) b(j), {_IMG} q WHERE q.y = floor((i + 0.5) * 24 / 10 - 0.5 + 0.5) AND q.x = floor((j + 0.5) * 32 / 12 - 0.5 + 0.5)")
def _nearest(t: Tables):
    return images.resize(_image(t), 10, 12).df


_PIXELS = "(SELECT y, x, c, CAST(v AS DOUBLE) AS v FROM {img})"


def _bilinear_sql(img: str, h: int, w: int, height: int, width: int) -> str:
    """Each pixel from the four around it, written out."""
    side = lambda f, n: f"greatest(0, least({n - 1}, {f}))"
    taps = " UNION ALL ".join(f"SELECT i, j, {side(f'floor(fy) + {a}', h)} AS y, {side(f'floor(fx) + {b}', w)} AS x, ({'fy - floor(fy)' if a else '1 - fy + floor(fy)'}) * ({'fx - floor(fx)' if b else '1 - fx + floor(fx)'}) AS p FROM g" for a in (0, 1) for b in (0, 1))
    return f"""WITH g AS (SELECT i, j, (i + 0.5) * {h} / {height} - 0.5 AS fy, (j + 0.5) * {w} / {width} - 0.5 AS fx FROM range({height}) a(i), range({width}) b(j)), q AS ({taps})
    SELECT CAST(i AS BIGINT) AS i0, CAST(j AS BIGINT) AS i1, CAST(c AS BIGINT) AS i2, {sql_num('sum(p * v)')} AS v FROM q JOIN {_PIXELS.format(img=img)} s ON s.y = q.y AND s.x = q.x GROUP BY i, j, c"""


@query("image_resize_bilinear", _bilinear_sql(_IMG, 24, 32, 48, 64))
def _bilinear(t: Tables):
    return images.resize(_image(t), 48, 64).df.withColumn("v", num(F.col("v")))


@query("image_downsample_to", _bilinear_sql(_IMG, 24, 32, 7, 9))
def _downsample_to(t: Tables):
    return images.downsample(_image(t), 7, 9).df.withColumn("v", num(F.col("v")))


@query("image_draw_scaled", f"SELECT CAST(y AS BIGINT) AS i0, CAST(x AS BIGINT) AS i1, CAST(c AS BIGINT) AS i2, CAST(CASE WHEN y BETWEEN 3 AND 10 AND x BETWEEN 28 AND 31 THEN ((2 + (y - 3) // 2) * 7 + (4 + (x - 28) // 2) * 3 + c * 50) % 256 ELSE v END AS BIGINT) AS v FROM {_IMG}")
def _draw_scaled(t: Tables):
    out = images.draw(_image(t), _image(t), 3, 28, 8, 10, (2, 4, 4, 5))  # a part of 4 x 5 in double size, cut off on the right
    return out.df.withColumn("v", F.col("v").cast("bigint"))


@query("image_draw", f"SELECT CAST(y AS BIGINT) AS i0, CAST(x AS BIGINT) AS i1, CAST(c AS BIGINT) AS i2, CAST(CASE WHEN y BETWEEN 5 AND 8 AND x BETWEEN 6 AND 9 THEN 9 ELSE v END AS BIGINT) AS v FROM {_IMG}")
def _draw(t: Tables):
    patch = tensor.constant(t.spark, 9, (4, 4, 3))
    return images.draw(patch, _image(t), 5, 6).df.withColumn("v", F.col("v").cast("bigint"))


@query("image_colorize", "SELECT c_custkey, CAST(CASE WHEN c_nationkey = 3 THEN 0 ELSE floor((greatest(least(c_acctbal, 9000), 0) / 9000) * 255 + 0.5) END AS BIGINT) AS b, CAST(CASE WHEN c_nationkey = 3 THEN 0 ELSE 255 END AS BIGINT) AS alpha FROM customer")
def _colorize(t: Tables):
    v = F.when(F.col("c_nationkey") == 3, float("nan")).otherwise(F.greatest(F.least(F.col("c_acctbal"), F.lit(9000.0)), F.lit(0.0)))
    out = images.colorize(t.customer.withColumn("x", v), "x", "gray", 0.0, 9000.0, steps=256)
    return out.select("c_custkey", F.col("b").cast("bigint").alias("b"), F.col("alpha").cast("bigint").alias("alpha"))


@query("image_binary", f"SELECT CAST(1 AS BIGINT) AS k, CAST(count(*) AS BIGINT) AS n, CAST(sum(v) AS BIGINT) AS total FROM {_IMG}")
def _binary(t: Tables):
    raw = images.to_binary(_image(t).df.withColumn("k", F.lit(1).cast("bigint")), "k")
    return images.from_binary(raw, "k", "data", 24, 32, 3).groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("file_append", "SELECT o_orderkey, o_totalprice FROM orders UNION ALL SELECT -o_orderkey, o_totalprice FROM orders")
def _append(t: Tables):
    path, v = f"{folder(t.spark)}/vector-{uuid.uuid4().hex}", t.orders.select("o_orderkey", "o_totalprice")
    io.write_vector(v, path)
    io.write_vector(v.withColumn("o_orderkey", -F.col("o_orderkey")), path)
    return t.spark.read.parquet(path)


@query("file_freeze_thaw", f"SELECT {_B('i0', 'i1')}, v FROM {_M}")
def _freeze(t: Tables):
    path, m = f"{folder(t.spark)}/tensor-{uuid.uuid4().hex}", _matrix(t)
    io.freeze(m.df, path, m.shape)
    df, shape = io.thaw(t.spark, path)
    return tensor.Tensor(df, shape).df.where(F.lit(shape == m.shape))


@query("file_text_charset", "SELECT n_name || ' é' AS value FROM nation")
def _text_charset(t: Tables):
    path = f"{folder(t.spark)}/text-{uuid.uuid4().hex}"
    t.nation.select(F.concat("n_name", F.lit(" é")).alias("value")).write.option("encoding", "ISO-8859-1").csv(path, sep="\x01", quote="")
    return io.read_text(t.spark, path, "ISO-8859-1")


@query("binary_peek", "SELECT o_orderkey, CAST(o_orderkey & 255 AS BIGINT) AS byte, CAST(o_orderkey AS BIGINT) AS whole FROM orders")
def _peek(t: Tables):
    raw = F.unhex(F.array_join(F.reverse(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.substring(F.lpad(F.hex("o_orderkey"), 16, "0"), k * 2 + 1, F.lit(2)))), ""))
    return t.orders.select("o_orderkey", io.peek(raw, 0, "uint8").cast("bigint").alias("byte"), io.peek(raw, 0, "int64").alias("whole"))


@query("string_encoding", "SELECT n_nationkey, CAST(strlen(n_name) + 1 AS BIGINT) AS n, n_name AS back FROM nation")
def _strings(t: Tables):
    raw = io.encoded(F.col("n_name"))
    return t.nation.select("n_nationkey", F.octet_length(raw).cast("bigint").alias("n"), io.decoded(raw).alias("back"))


# windows of streams, over the table as a batch


@query("stream_tumbling", "SELECT CAST(epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS BIGINT) AS start, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def _tumbling(t: Tables):
    d = windows.tumbling(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", "1 hour", ["event_type"], {"n": F.count("*")})
    return d.select(F.unix_micros("start").alias("start"), "event_type", "n")


@query("stream_sliding", "SELECT CAST(epoch_us(time_bucket(INTERVAL 12 HOUR, ts)) - k * 43200000000 AS BIGINT) AS start, CAST(count(*) AS BIGINT) AS n FROM events, range(2) r(k) GROUP BY ALL")
def _sliding(t: Tables):
    d = windows.sliding(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", "12 hours", "1 hour", [], {"n": F.count("*")})
    return d.select(F.unix_micros("start").alias("start"), "n")


@query("stream_session", "SELECT user_id, CAST(count(*) AS BIGINT) AS sessions FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events) WHERE before IS NULL OR ts - before > INTERVAL 2 HOUR GROUP BY user_id")
def _session(t: Tables):
    d = windows.session(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "2 hours", "1 hour", ["user_id"], {"n": F.count("*")})
    return d.groupBy("user_id").agg(F.count("*").alias("sessions"))
