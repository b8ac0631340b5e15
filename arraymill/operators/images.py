"""Images as [y x c] tensors of bytes: resizing and colour gradients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arraymill.operators.tensor import Tensor, compute, select

#: Gradients as colours (blue, green, red) at even places.
GRADIENTS = {"gray": [(0, 0, 0), (255, 255, 255)], "green-red": [(0, 255, 0), (0, 255, 255), (0, 0, 255)], "blue-red": [(255, 0, 0), (255, 255, 255), (0, 0, 255)]}


def gradient_line(name: str, steps: int = 200, invert: bool = False) -> list[tuple[int, int, int]]:
    """Evenly spaced colours of a gradient."""
    stops = GRADIENTS[name][::-1] if invert else GRADIENTS[name]
    out = []
    for i in range(steps):
        at = i * (len(stops) - 1) / max(1, steps - 1)
        k = min(int(at), len(stops) - 2)
        out.append(tuple(round(a + (b - a) * (at - k)) for a, b in zip(stops[k], stops[k + 1], strict=True)))
    return out


def colorize(df: DataFrame, v: str, name: str, least: float | None = None, most: float | None = None, steps: int = 200, invert: bool = False) -> DataFrame:
    """Adds b, g, r and alpha: v clamped to least ... most (of the data if not given); alpha is 0 for NaN and infinities."""
    x = F.col(v).cast("double")
    good = ~F.isnan(x) & (F.abs(x) < float("inf"))
    if least is None or most is None:
        lo, hi = df.agg(F.min(F.when(good, x)), F.max(F.when(good, x))).first()
        least, most = lo if least is None else least, hi if most is None else most
    line = gradient_line(name, steps, invert)
    wide = (most or 0) - (least or 0) or 1.0
    at = F.least(F.greatest(F.floor((x - (least or 0)) / wide * (steps - 1) + 0.5), F.lit(0)), F.lit(steps - 1)).cast("int")
    part = lambda k: F.when(good, F.get(F.array(*(F.lit(c[k]) for c in line)), at)).otherwise(0)
    return df.select("*", part(0).alias("b"), part(1).alias("g"), part(2).alias("r"), F.when(good, 255).otherwise(0).alias("alpha"))


def _scaled(t: Tensor, height: int, width: int) -> tuple[DataFrame, Column, Column]:
    spark: SparkSession = t.df.sparkSession
    grid = compute(spark, (height, width), lambda i, j: F.lit(0)).df.select("i0", "i1")
    return grid, (F.col("i0") + 0.5) * t.shape[0] / height - 0.5, (F.col("i1") + 0.5) * t.shape[1] / width - 0.5


def resize_nearest(t: Tensor, height: int, width: int) -> Tensor:
    grid, y, x = _scaled(t, height, width)
    want = grid.withColumn("_y", F.floor(y + 0.5)).withColumn("_x", F.floor(x + 0.5))
    src = t.df.select(F.col("i0").alias("_y"), F.col("i1").alias("_x"), "i2", "v")
    return Tensor(want.join(src, ["_y", "_x"]).select("i0", "i1", "i2", "v"), (height, width, t.shape[2]))


def resize_bilinear(t: Tensor, height: int, width: int) -> Tensor:
    """Each pixel from the four around it, the edge repeated."""
    grid, y, x = _scaled(t, height, width)
    h, w = t.shape[:2]
    base = grid.withColumn("_fy", y).withColumn("_fx", x)
    taps = base.withColumn("_d", F.explode(F.array(*(F.struct(F.lit(a).alias("y"), F.lit(b).alias("x")) for a in (0, 1) for b in (0, 1)))))
    near = lambda f, d, n: F.least(F.greatest(F.floor(F.col(f)) + F.col(f"_d.{d}"), F.lit(0)), F.lit(n - 1))
    part = lambda f, d: F.when(F.col(f"_d.{d}") == 1, F.col(f) - F.floor(F.col(f))).otherwise(1 - F.col(f) + F.floor(F.col(f)))
    taps = taps.select("i0", "i1", near("_fy", "y", h).alias("_y"), near("_fx", "x", w).alias("_x"), (part("_fy", "y") * part("_fx", "x")).alias("_p"))
    src = t.df.select(F.col("i0").alias("_y"), F.col("i1").alias("_x"), "i2", "v")
    return Tensor(taps.join(src, ["_y", "_x"]).groupBy("i0", "i1", "i2").agg(F.sum(F.col("_p") * F.col("v")).alias("v")), (height, width, t.shape[2]))


def resize(t: Tensor, height: int, width: int) -> Tensor:
    """Bilinear to enlarge, else nearest."""
    return resize_bilinear(t, height, width) if height > t.shape[0] or width > t.shape[1] else resize_nearest(t, height, width)


def downsample(t: Tensor, height: int | None = None, width: int | None = None) -> Tensor:
    """Half the size, rounded down, each pixel the mean of four; or bilinear to a given size."""
    h, w = t.shape[0] // 2, t.shape[1] // 2
    if height is not None and width is not None and (height, width) != (h, w):
        return resize_bilinear(t, height, width)
    inside = t.df.where((F.col("i0") < 2 * h) & (F.col("i1") < 2 * w))
    half = inside.groupBy(F.floor(F.col("i0") / 2).alias("i0"), F.floor(F.col("i1") / 2).alias("i1"), "i2").agg(F.avg("v").alias("v"))
    return Tensor(half, (h, w, t.shape[2]))


def crop(t: Tensor, y: int, x: int, height: int, width: int) -> Tensor:
    """A part of an image, cut off where the image ends."""
    height, width = min(height, t.shape[0] - y), min(width, t.shape[1] - x)
    return select(t, range(y, y + height), range(x, x + width))


def draw(src: Tensor, dst: Tensor, y: int, x: int, height: int | None = None, width: int | None = None, part: tuple[int, int, int, int] | None = None, bilinear: bool = False) -> Tensor:
    """dst with src, or a part (y, x, height, width) of it, drawn at a place in a size; what falls outside is cut off."""
    src = crop(src, *part) if part else src
    to = (height or src.shape[0], width or src.shape[1])
    if to != src.shape[:2]:
        src = (resize_bilinear if bilinear else resize_nearest)(src, *to)
    moved = src.df.select((F.col("i0") + y).alias("i0"), (F.col("i1") + x).alias("i1"), "i2", F.col("v").alias("_new"), F.lit(True).alias("_set"))
    out = dst.df.join(moved, ["i0", "i1", "i2"], "left")
    return Tensor(out.select("i0", "i1", "i2", F.when(F.col("_set"), F.col("_new")).otherwise(F.col("v")).alias("v")), dst.shape)


def load(spark: SparkSession, path: str) -> DataFrame:
    """origin, height, width, channels, data (blue, green, red in row-major order) of image files, by Spark's own source; from_files() gives pixels."""
    return spark.read.format("image").load(path).select("image.origin", "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


def from_files(images: DataFrame) -> DataFrame:
    """origin, i0, i1, i2, v of loaded images of any sizes."""
    rows = images.select("*", F.explode(F.sequence(F.lit(0), F.octet_length("data") - 1)).alias("_k"))
    line, byte = F.col("width") * F.col("channels"), F.conv(F.hex(F.substring(F.col("data"), F.col("_k") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.select("origin", F.floor(F.col("_k") / line).alias("i0"), (F.floor(F.col("_k") / F.col("channels")) % F.col("width")).alias("i1"), (F.col("_k") % F.col("channels")).cast("bigint").alias("i2"), byte.alias("v"))


def from_binary(df: DataFrame, key: str, data: str, height: int, width: int, channels: int) -> DataFrame:
    """key, i0, i1, i2, v from raw bytes in row-major order."""
    at = F.sequence(F.lit(0), F.lit(height * width * channels - 1))
    byte = F.conv(F.hex(F.substring(F.col(data), F.col("_k") + 1, F.lit(1))), 16, 10).cast("int")
    rows = df.select(key, data, F.explode(at).alias("_k"))
    return rows.select(key, F.floor(F.col("_k") / (width * channels)).alias("i0"), (F.floor(F.col("_k") / channels) % width).alias("i1"), (F.col("_k") % channels).cast("bigint").alias("i2"), byte.alias("v"))


def to_binary(df: DataFrame, key: str) -> DataFrame:
    """key, data: pixels (key, i0, i1, i2, v) as raw bytes."""
    pixels = F.sort_array(F.collect_list(F.struct("i0", "i1", "i2", "v")))
    text = F.array_join(F.transform(pixels, lambda p: F.lpad(F.hex(p["v"].cast("bigint")), 2, "0")), "")
    return df.groupBy(key).agg(F.unhex(text).alias("data"))
