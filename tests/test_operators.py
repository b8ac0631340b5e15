import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from arraymill.operators import argops, buffers, convolve, images, prefix, rolling, sets, stats, tensor
from arraymill.sources import io
from arraymill.streaming import windows

NAN = float("nan")


def values(df, order, c):
    return [r[0] for r in df.orderBy(order).select(c).collect()]


def test_statistics(vector):
    d = vector([NAN if k == 50 else k for k in range(100)])
    r = d.agg(*(stats.STATISTICS[n](F.col("v"), "remove").alias(n) for n in ("min", "max", "median", "standard_deviation", "skew", "quartile_1", "quartile_3", "variance", "n_elems"))).first()
    assert (r["min"], r["max"], r["median"], r["quartile_1"], r["quartile_3"], r["n_elems"]) == (0, 99, 49, 24, 75, 99)
    assert r["standard_deviation"] == pytest.approx(29.159, abs=1e-3) and r["skew"] == pytest.approx(5.3027e-4, abs=1e-6) and r["variance"] == pytest.approx(850.252, abs=1e-2)
    assert vector(range(50)).agg(stats.quartiles(F.col("v"))).first()[0] == [0, 11.75, 24.5, 37.25, 49]
    p = vector([1, 2, 3, 4, 10])
    assert p.agg(stats.percentiles(F.col("v"), (25, 50, 75))).first()[0] == [1.5, 3, 7]
    assert p.agg(stats.percentiles(F.col("v"), (25, 50, 75), "r1")).first()[0] == [2, 3, 4]
    empty = vector([NAN]).agg(stats.mean(F.col("v")), stats.least(F.col("v")), stats.n_values(F.col("v")), stats.standard_deviation(F.col("v"))).first()
    assert math.isnan(empty[0]) and math.isnan(empty[1]) and empty[2:] == (0, 0.0)
    with pytest.raises(Exception, match="NaN"):
        vector([1, NAN]).agg(stats.total(F.col("v"), "exception")).collect()


def test_outliers_mode_and_correlations(spark, vector):
    flags = stats.outliers(vector([*range(50), -100, 100]), "v").where("outlier").select("v")
    assert sorted(r[0] for r in flags.collect()) == [-100, 100]
    assert stats.mode(spark.createDataFrame([(w,) for w in "hey you guys hey hey".split()], "w string"), "w").first()[0] == "hey"
    pairs = spark.createDataFrame([(0, float(a), float(b)) for a, b in [(1, 2), (2, 1), (3, 4), (4, 3), (5, 5), (5, 6)]], "g int, x double, y double")
    assert stats.kendall(pairs, "x", "y", ["g"]).first()["kendall"] == pytest.approx(10 / math.sqrt(14 * 15))
    assert stats.spearman(pairs, "x", "y", ["g"]).first()["spearman"] == pytest.approx(np.corrcoef([1, 2, 3, 4, 5.5, 5.5], [2, 1, 4, 3, 5, 6])[0, 1])
    line = pairs.agg(*stats.linear_regression(F.col("x"), 2 * F.col("x") + 1)).first()
    assert line["slope"] == pytest.approx(2) and line["intercept"] == pytest.approx(1) and line["mse"] == pytest.approx(0, abs=1e-9)


def test_index_space(vector):
    d = vector([NAN, 2, 5, NAN, 1, 6, 3, 4, NAN])
    assert values(argops.argsort(d, "v", "idx"), "pos", "idx") == [4, 1, 6, 7, 2, 5, 0, 3, 8]
    assert values(argops.argsort(d, "v", "idx", ["g"], nan="first"), "pos", "idx")[:3] == [0, 3, 8]
    with pytest.raises(Exception, match="NaN"):
        argops.argsort(d, "v", "idx", ["g"], nan="exception").collect()
    r = d.agg(argops.argmin(F.col("v"), F.col("idx")), argops.argmax(F.col("v"), F.col("idx")), argops.index_of(F.col("v") == 9, F.col("idx"), 9)).first()
    assert r[:] == (4, 5, 9)
    runs = argops.argpartition(vector([1, 1, 2, 2, 2, 3]), "v", "idx", ["g"]).orderBy("run").collect()
    assert [(x["first"], x["last"], x["n"]) for x in runs] == [(0, 1, 2), (2, 4, 3), (5, 5, 1)]
    groups = argops.arggroup(vector(range(20)), F.col("v") % 2, "idx").orderBy("first").collect()
    assert [x["indexes"] for x in groups] == [list(range(0, 20, 2)), list(range(1, 20, 2))]
    ten = vector(range(10))
    assert [ten.agg(argops.binary_search(F.col("v"), F.lit(t))).first()[0] for t in (-1, 0, 4.5, 9, 10)] == [0, 0, 5, 9, 10]
    assert sorted(values(argops.argshuffle(ten, "idx", 1), "pos", "idx")) == list(range(10))


@pytest.mark.parametrize(("position", "first"), [("left", [0, 1, 3, 6, 10, 15]), ("center", [3, 6, 10, 15]), ("right", [10, 15])])
def test_rolling(vector, position, first):
    got = values(rolling.fixed(vector(range(20)), "v", ["g"], "idx", 5, "sum", position), "idx", "rolled")
    assert got[: len(first)] == first
    pad = np.pad(np.arange(20.0), (-rolling.offsets(5, position)[0], rolling.offsets(5, position)[1]), mode="edge")
    assert got == [pad[k : k + 5].sum() for k in range(20)]


def test_ordered_vectors(vector):
    d = vector([1, 2, 4, 7, 11, 16])
    assert values(rolling.gradient1d(d, "v", ["g"], "idx"), "idx", "gradient") == [1, 1.5, 2.5, 3.5, 4.5, 5]
    assert values(rolling.diff1d(d, "v", ["g"], "idx"), "idx", "diff") == [1, 2, 3, 4, 5]
    assert values(rolling.shift(d, "v", ["g"], "idx", 2), "idx", "shifted") == [1, 1, 1, 2, 4, 7]
    assert values(rolling.shift(d, "v", ["g"], "idx", -2), "idx", "shifted") == [4, 7, 11, 16, 16, 16]
    assert values(rolling.fill_range(vector([1, 3, 8, 20]), "v", ["g"], 3), "v", "v") == [1, 3, 5.5, 8, 11, 14, 17, 20]
    product = values(rolling.cumprod(vector([2, -3, NAN, 0, 5]), "v", ["g"], "idx"), "idx", "run")
    assert product[0] == pytest.approx(2) and product[1] == pytest.approx(-6) and math.isnan(product[2]) and product[3:] == [0, 0]
    assert values(prefix.running_total(vector(range(100)), ["idx"], "v", "run"), "idx", "run") == list(np.cumsum(np.arange(100.0)))


def test_convolution(vector):
    d = vector([1, 2, 3])
    for mode, want in (("full", [0, 1, 2.5, 4, 1.5]), ("same", [1, 2.5, 4]), ("valid", [2.5])):
        assert values(convolve.convolve1d(d, "v", ["g"], "idx", [0, 1, 0.5], mode=mode), "pos", "value") == pytest.approx(want)
    assert values(convolve.gaussian1d(vector([1, 2, 3, 4, 5]), "v", ["g"], "idx", 1), "pos", "value") == pytest.approx([1.42704, 2.06782, 3, 3.93218, 4.57296], abs=1e-4)
    long = values(convolve.same_long(vector(range(50)), "v", "idx", [0.2, 0.5, 0.3], block=7), "idx", "filtered")
    assert long == pytest.approx(list(convolve.correlate_array(np.arange(50.0), [0.2, 0.5, 0.3], "same")))
    fft = convolve.correlate_array(np.arange(50.0), [0.2, 0.5, 0.3], "full", fft=True)
    assert fft == pytest.approx(convolve.correlate_array(np.arange(50.0), [0.2, 0.5, 0.3], "full"))


def test_tensors(spark):
    t = tensor.compute(spark, (4, 3), lambda i, j: (i * 3 + j).cast("double"))
    assert tensor.to_nested(tensor.reduce_axis(t, F.sum, 0)) == [18, 22, 26] and tensor.to_nested(tensor.reduce_axis(t, F.sum, 1)) == [3, 12, 21, 30]
    a = np.arange(12.0).reshape(4, 3)
    assert tensor.to_nested(tensor.transpose(t, [1, 0])) == a.T.tolist()
    assert tensor.to_nested(tensor.rotate(t, [1, 0])) == np.roll(a, -1, 0).tolist() or tensor.to_nested(tensor.rotate(t, [1, 0])) == np.roll(a, 1, 0).tolist()
    assert tensor.to_nested(tensor.select(t, [2, 0], "reverse")) == a[[2, 0]][:, ::-1].tolist()
    assert tensor.to_nested(tensor.broadcast(tensor.from_nested(spark, [5, 6, 7]), (3, 3))) == [[5, 6, 7]] * 3
    assert tensor.to_nested(tensor.matmul(t, tensor.transpose(t, [1, 0]))) == (a @ a.T).tolist()
    with pytest.raises(ValueError):
        tensor.transpose(t, [0, 0])
    with pytest.raises(ValueError):
        tensor.from_nested(spark, [[1], [1, 2]])


def test_sets_structs_and_buffers(spark, tmp_path):
    a, b = sets.span(spark, 0, 10), sets.span(spark, 5, 15)
    assert sets.symmetric_difference(a, b).count() == 10 and sets.reduce_intersection([a, b]).count() == 5
    assert sets.contains_range(a, 2, 5).first()[0] and not sets.contains_range(a, 8, 12).first()[0]
    offsets, size, align = sets.layout([("x", "int8", 1), ("y", "float64", 2), ("z", [("a", "int16", 1), ("b", "int32", 1)], 1)])
    assert (offsets["y"], offsets["z"], offsets["z.b"], size, align) == (8, 24, 28, 32, 8)
    assert sets.spark_struct([("x", "int8", 1), ("y", "float64", 2)]) == "struct<x:tinyint, y:array<double>>"
    v = buffers.container(spark, "int32", [3, 1, 2])
    assert buffers.to_array(buffers.reverse(v, 3)) == [2, 1, 3] and buffers.to_array(buffers.set_value(v, 1, 9)) == [3, 9, 2]
    np.arange(5, dtype="<i2").tofile(tmp_path / "x.bin")
    assert values(io.read_binary(spark, str(tmp_path / "x.bin"), "int16"), "idx", "v") == [0, 1, 2, 3, 4]
    io.freeze(tensor.compute(spark, (2, 2), lambda i, j: i + j).df, str(tmp_path / "t"), (2, 2))
    assert io.thaw(spark, str(tmp_path / "t"))[1] == (2, 2)
    assert images.gradient_line("gray", 3) == [(0, 0, 0), (128, 128, 128), (255, 255, 255)]


def test_streaming_matches_batch(spark, tmp_path):
    rows = spark.sql("select timestamp_seconds(id * 600) as ts, id % 3 as k from range(100)")
    rows.write.parquet(str(tmp_path / "in"))
    run = lambda d: windows.tumbling(d, "ts", "1 hour", "1 hour", ["k"], {"n": F.count("*")})
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = run(stream).writeStream.format("memory").queryName("out").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(spark.table("out").collect()) == sorted(run(rows).collect())


def test_quantiles_of_groups_of_any_size(spark):
    rng = np.random.default_rng(3)
    data = {0: [5.0], 1: rng.integers(0, 6, 40).astype(float).tolist(), 2: [NAN, None, 3.0, 1.0], 3: [None, NAN], None: rng.normal(size=25).tolist()}
    d = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "g int, v double").repartition(5)
    for kind in ("legacy", "r1", "r2", "r3", "r7"):
        small = d.groupBy("g").agg(stats.percentiles(F.col("v"), (0.001, 25, 50, 90, 100), kind).alias("p")).collect()
        got = {r["g"]: r["percentiles"] for r in stats.quantiles(d, "v", (0.001, 25, 50, 90, 100), kind, ["g"]).collect()}
        assert {r["g"] for r in small} == set(got)
        for r in small:
            assert got[r["g"]] == pytest.approx(r["p"], nan_ok=True), (kind, r["g"])
    whole = [v for vs in data.values() for v in vs if v is not None and v == v]
    assert stats.medians(d, "v").first()["median"] == sorted(whole)[len(whole) // 2]
    assert stats.quantiles(d, "v", (50,), "r7").first()[0][0] == pytest.approx(np.median(whole))
    assert stats.quantiles(d.limit(0), "v", (50,), keys=["g"]).count() == 0
    plan = stats.quantiles(d, "v", (50,), keys=["g"])._jdf.queryExecution().toString()
    assert "collect_list" not in plan
    both = stats.describe(d, "v", ("n_elems", "median", "quartile_3", "max"), ["g"]).where("g = 1").first()
    assert both["n_elems"] == 40 and both["median"] == sorted(data[1])[20] and both["max"] == max(data[1])


def test_fold_by_parts(spark):
    d = spark.createDataFrame([(k % 3, float(k)) for k in range(200)] + [(7, None)], "g int, v double")
    got = {r["g"]: r["value"] for r in stats.fold_by(d, lambda a, b: F.greatest(a, b) + 0.0, "v", ["g"], chunk=5).collect()}
    assert got == {0: 198.0, 1: 199.0, 2: 197.0}
    assert stats.fold_by(d, lambda a, b: a + b, "v", chunk=7).first()[0] == sum(range(200))


def test_positions_within_hot_and_null_keys(spark):
    d = spark.createDataFrame([(None if k % 7 == 0 else "hot" if k % 2 else "b", k) for k in range(100)], "g string, i int")
    rows = prefix.positions_within(d, ["g"], ["i"]).collect()
    for g in (None, "hot", "b"):
        own = sorted((r["i"], r["pos"]) for r in rows if r["g"] == g)
        assert [p for _, p in own] == list(range(len(own)))
    assert len(rows) == 100


def test_blocks_with_halos(spark, vector):
    v = [float((k * 37) % 23) for k in range(50)]
    d = vector(v).select("idx", "v").repartition(3)
    keyed = vector(v)
    for f, back, ahead, name in [
        (lambda x, k: rolling.fixed(x, "v", k, "idx", 7), 3, 3, "rolled"),
        (lambda x, k: rolling.fixed(x, "v", k, "idx", 4, "min", "left", "zero"), 3, 0, "rolled"),
        (lambda x, k: rolling.gradient1d(x, "v", k, "idx"), 1, 1, "gradient"),
        (lambda x, k: rolling.shift(x, "v", k, "idx", -9), 0, 9, "shifted"),
        (lambda x, k: rolling.diff1d(x, "v", k, "idx"), 1, 1, "diff"),
    ]:
        got = sorted((r["idx"], r[name]) for r in prefix.in_blocks(d, ["idx"], f, back, ahead, block=4).collect())
        assert got == [(a, pytest.approx(b)) for a, b in sorted((r["idx"], r[name]) for r in f(keyed, ["g"]).collect())], name
    assert rolling.gradient1d(d.limit(0), "v", [], "idx").count() == 0
    nan = spark.createDataFrame([(0, 3.0), (1, NAN), (2, -2.0), (3, 0.0), (4, 5.0)], "idx bigint, v double")
    assert [r["run"] for r in rolling.cumprod(nan.where("idx < 3"), "v", [], "idx").orderBy("idx").collect()] == pytest.approx([3.0, NAN, -6.0], nan_ok=True)
    assert [r["run"] for r in rolling.cumprod(nan, "v", [], "idx").orderBy("idx").collect()][3:] == [0.0, 0.0]
    assert [r["run"] for r in rolling.cummin(nan, "v", [], "idx").orderBy("idx").collect()] == [3.0, pytest.approx(NAN, nan_ok=True), -2.0, -2.0, -2.0]


def test_correlate_long(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=40)
    d = spark.createDataFrame([(k, float(x)) for k, x in enumerate(v)], "idx bigint, v double").repartition(4)
    some = [(5, "same", e, False) for e in ("zero", "clamp", "reflect", "wrap", "constant")] + [(4, "full", "wrap", False), (4, "full", "constant", True), (4, "same", "reflect", False), (5, "valid", "zero", True), (1, "full", "zero", False)]
    for m, mode, edge, fft in some:
        kernel = rng.normal(size=m).tolist()
        got = convolve.correlate_long(d, "v", "idx", kernel, mode, edge, 2.5, 2, fft, block=7).orderBy("idx").collect()
        want = convolve.correlate_array(v, kernel, mode, edge, 2.5, 2)
        assert [r["idx"] for r in got] == list(range(len(want))) and [r["filtered"] for r in got] == pytest.approx(want.tolist()), (m, mode, edge)
    assert convolve.correlate_long(d.limit(0), "v", "idx", [1.0]).count() == 0


def test_variable_windows(spark):
    d = spark.createDataFrame([(0, float(k)) for k in range(20)], "g int, v double")
    got = sorted((r["first"], r["past"]) for r in rolling.variable_steps(d, ["g"], "v", 5, 2, {"n": F.count("*")}).collect())
    assert got == [(k, min(20, k + 5)) for k in range(0, 20, 2)]
    every = sorted((r["first"], r["past"]) for r in rolling.variable_steps(d, [], "v", 5, 0, {"n": F.count("*")}).collect())
    assert every == [(k, min(20, k + 5)) for k in range(20)]
    near = rolling.variable(d, ["g"], F.col("v"), 2.5, {"n": "count(*)"}, "center").orderBy("v").collect()
    assert [r["n"] for r in near] == [2] + [3] * 18 + [2]


def test_search_with_ties(spark):
    data = spark.createDataFrame([(float(k // 5),) for k in range(50)], "x double")
    got = argops.search_many(data, "x", spark.createDataFrame([(3.0,), (3.0,), (2.5,), (99.0,), (-1.0,)], "t double"), "t").collect()
    assert sorted(map(tuple, got)) == [(-1.0, 0), (2.5, 15), (3.0, 15), (3.0, 15), (99.0, 50)]


def test_matmul_in_blocks(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(7, 5)), rng.normal(size=(5, 4))
    for block in (2, 256):
        got = tensor.to_nested(tensor.matmul(tensor.from_nested(spark, a.tolist()), tensor.from_nested(spark, b.tolist()), block))
        assert np.allclose(got, a @ b)


def test_blocks_of_a_short_vector(vector):
    got = rolling.downsample_blocks(vector([1, 2, 3, 4, 5]), "v", ["g"], "idx", 2).orderBy("pos").collect()
    assert [r["v"] for r in got] == [2.0, 4.5]  # 2.5 values a block: 0 to 2, then from 3 on
    assert rolling.downsample(vector([1, 2]), "v", ["g"], "idx", 9).count() == 2


def test_image_files(spark, tmp_path):
    import struct
    import zlib

    rows = [[(10, 20, 30), (40, 50, 60)], [(70, 80, 90), (1, 2, 3)], [(5, 5, 5), (250, 251, 252)]]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + bytes(v for p in r for v in p) for r in rows)
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 3, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    pixels = {(r["i0"], r["i1"], r["i2"]): r["v"] for r in images.from_files(images.load(spark, str(tmp_path))).collect()}
    assert pixels == {(y, x, c): rows[y][x][2 - c] for y in range(3) for x in range(2) for c in range(3)}


def test_odd_images_and_opaque_reduction(spark):
    t = tensor.compute(spark, (5, 7, 1), lambda i, j, k: i * 10 + j)
    half = images.downsample(t)
    assert half.shape == (2, 3, 1) and half.df.count() == 6 and half.df.where("i0 = 1 and i1 = 2").first()["v"] == (24 + 25 + 34 + 35) / 4
    assert sets.map_reduce_opaque(spark, 1000, lambda i: int(i.max()), max, "bigint").first()[0] == 999


def test_kendall_of_any_size(spark):
    rng = np.random.default_rng(11)
    rows = [(g, float(rng.integers(0, 9)), float(rng.integers(0, 30))) for g in (1, 2, None) for _ in range(60)] + [(5, 1.0, 2.0), (6, NAN, 2.0), (6, 1.0, None)]
    d = spark.createDataFrame(rows, "g int, x double, y double").repartition(3)
    got = {r["g"]: r["kendall"] for r in stats.kendall_scan(d, "x", "y", ["g"]).collect()}
    want = {r["g"]: NAN if r["kendall"] is None else r["kendall"] for r in stats.kendall(d.where("x is not null and y is not null and not isnan(x)"), "x", "y", ["g"]).collect()}
    assert got == pytest.approx(want, nan_ok=True) and len(got) == 4


def test_late_rows_and_windows_on_a_stream(spark, tmp_path):
    """Rows behind the watermark of an earlier batch are left out; sliding and session windows on a real stream."""
    batches = [(0, 10, 70), (300, 310), (5, 305)]  # minutes; in the last, 5 is behind 310 - 60
    schema = spark.sql("select timestamp_seconds(0) as ts, 1 as k").schema

    def run(name, f):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / f"in-{name}"))
        q = f(stream).writeStream.format("memory").queryName(name).outputMode("append").start()
        for minutes in batches:
            rows = " union all ".join(f"select timestamp_seconds({m} * 60) as ts, 1 as k" for m in minutes)
            spark.sql(rows).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in-{name}"))
            q.processAllAvailable()
        q.stop()
        return {r["start"].timestamp() / 60: r["n"] for r in spark.table(name).collect()}

    n = {"n": F.count("*")}
    (tmp_path / "in-hours").mkdir()
    hours = run("hours", lambda d: windows.tumbling(d, "ts", "1 hour", "1 hour", ["k"], n))
    assert hours[0.0] == 2 and hours[60.0] == 1
    (tmp_path / "in-slides").mkdir()
    slides = run("slides", lambda d: windows.sliding(d, "ts", "1 hour", "30 minutes", "1 hour", ["k"], n))
    assert slides[0.0] == 2 and slides[-30.0] == 2 and slides[30.0] == 1 and slides[60.0] == 1
    (tmp_path / "in-gaps").mkdir()
    gaps = run("gaps", lambda d: windows.session(d, "ts", "20 minutes", "1 hour", ["k"], n))
    assert gaps[0.0] == 2 and gaps[70.0] == 1


def test_running_sum_keeps_its_precision(spark):
    n = 400_000
    d = spark.range(n, numPartitions=4).select("id", (1e-4 + F.pmod(F.col("id") * 7919, F.lit(1000)) / 1e8 + 1.0).alias("v"))
    got = prefix.running_total(d, ["id"], "v", "run").select("id", "run").orderBy("id").toPandas()["run"].to_numpy()
    want = np.cumsum((1e-4 + np.arange(n) * 7919 % 1000 / 1e8 + 1.0).astype(np.longdouble))
    assert float(np.max(np.abs(got - want) / want)) < 1e-15


def test_tree_sums(spark):
    """Through several rounds of blocks; by position alone, whatever the partitions."""
    rng = np.random.default_rng(5)
    v = rng.lognormal(size=5000) * rng.choice([1.0, 1e9, -1e-9], 5000)
    nodes = [v]
    while len(nodes[-1]) > 1:
        nodes.append(np.array([np.add.accumulate(nodes[-1][i : i + 16])[-1] for i in range(0, len(nodes[-1]), 16)]))
    want = []
    for end in range(1, len(v) + 1):
        total = 0.0
        for k in reversed(range(len(nodes))):
            for x in nodes[k][end // 16 ** (k + 1) * 16 : end // 16**k]:
                total += x
        want.append(total)
    d = spark.createDataFrame([(i, None if i % 7 == 0 else float(x), float(x)) for i, x in enumerate(v)], "id long, u double, v double")
    for parts in (1, 3):
        got = prefix.tree_sums(d.repartition(parts), ["id"], {"run": F.col("v"), "n": F.col("u").isNotNull()}, levels=1).orderBy("id").toPandas()
        assert list(got.columns) == ["id", "u", "v", "run", "n"] and got["run"].tolist() == want
        assert got["n"].tolist() == np.cumsum(np.arange(5000) % 7 != 0).tolist()
    assert prefix.tree_sums(d.where("id < 320"), ["id"], {"run": F.col("v")}, levels=2).orderBy("id").toPandas()["run"].tolist() == want[:320]
    assert prefix.tree_sums(d.limit(0), ["id"], {"run": F.col("v")}).count() == 0


def test_staged_reduction_of_many_batches(spark):
    import pandas as pd

    seen = spark.sparkContext.accumulator(0)

    def step(s):
        seen.add(1)
        return pd.DataFrame({"n": [len(s), 0], "s": [s.sum(), 0.0]})

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        d = spark.range(5000, numPartitions=1).selectExpr("id % 10 AS a", "CAST(id % 2 AS string) AS b", "CAST(id AS double) AS v")
        got = stats.staged(d, ["a", "b"], "v", step, lambda g: [int(g["n"].sum()), g["s"].sum()], "n long, s double", "n long, s double").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r[:] for r in got) == [(k, str(k % 2), 500, float(sum(range(k, 5000, 10)))) for k in range(10)]
    assert seen.value == 10  # one state of a group for all batches of a task
