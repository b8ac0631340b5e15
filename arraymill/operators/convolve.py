"""Correlation, convolution and filters of ordered vectors with short kernels.

The kernel is a list on the driver. A vector per key is filtered by lags in one
window. A single long vector is cut into blocks with a halo, so that its parts
are filtered in parallel, each by FFT where that pays (overlap-save).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EDGES = {"zero": "constant", "clamp": "edge", "nearest": "edge", "reflect": "symmetric", "wrap": "wrap", "constant": "constant"}


def pads(m: int, mode: str) -> tuple[int, int]:
    """Values put before and after a vector for a kernel of m."""
    if mode == "full":
        return m - 1, m - 1
    if mode == "valid":
        return 0, 0
    return (m // 2, m // 2) if m % 2 else (m // 2 - 1, m // 2)


def correlate_array(data: np.ndarray, kernel: list[float], mode: str = "full", edge: str = "zero", constant: float = 0.0, step: int = 1, fft: bool = False) -> np.ndarray:
    """out[i] is the sum of padded[i step + k] kernel[k]."""
    w = np.asarray(kernel, float)
    left, right = pads(len(w), mode)
    kind = EDGES[edge]
    p = np.pad(np.asarray(data, float), (left, right), mode=kind, **({"constant_values": constant if edge == "constant" else 0.0} if kind == "constant" else {})) if len(data) else np.zeros(0)
    if len(p) < len(w):
        return np.zeros(0)
    if fft:
        n = 1 << (len(p) + len(w) - 1).bit_length()
        out = np.fft.irfft(np.fft.rfft(p, n) * np.fft.rfft(w[::-1], n), n)[len(w) - 1 : len(p)]
    else:
        out = np.correlate(p, w, "valid")
    return out[::step]


def correlate1d(df: DataFrame, x: str, keys: list[str], order: str, kernel: list[float], mode: str = "full", edge: str = "zero", constant: float = 0.0, step: int = 1, fft: bool | None = None) -> DataFrame:
    """keys, pos, value: each key's vector against the kernel. A vector is one task's work; fft by default where it pays."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    head = "".join(f"`{k}` {kinds[k]}, " for k in keys)

    def one(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        v = g.sort_values(order)[x].to_numpy(float)
        out = correlate_array(v, kernel, mode, edge, constant, step, fft if fft is not None else len(v) * len(kernel) >= 64_000)
        return pd.DataFrame({**{k: [z] * len(out) for k, z in zip(keys, key, strict=True)}, "pos": np.arange(len(out)), "value": out})

    return df.select(*keys, order, x).groupBy(*keys).applyInPandas(one, f"{head}pos long, value double")


def convolve1d(df: DataFrame, x: str, keys: list[str], order: str, kernel: list[float], **options) -> DataFrame:
    """Correlation with the reversed kernel."""
    return correlate1d(df, x, keys, order, list(reversed(kernel)), **options)


def same(df: DataFrame, x: str, keys: list[str], order: str, kernel: list[float], edge: str = "zero", name: str = "filtered") -> DataFrame:
    """Correlation in mode "same" as one window of lags, with zero or clamped edges; for short kernels."""
    w = Window.partitionBy(*keys).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left, _ = pads(len(kernel), "same")

    def at(k: int) -> Column:
        d = k - left
        got = F.col(x) if d == 0 else F.lag(x, -d).over(w) if d < 0 else F.lead(x, d).over(w)
        stand = F.lit(0.0) if edge == "zero" else F.first(x).over(whole) if d < 0 else F.last(x).over(whole)
        return F.coalesce(got, stand) * kernel[k]

    return df.withColumn(name, sum((at(k) for k in range(1, len(kernel))), at(0)))


def correlate_long(df: DataFrame, x: str, idx: str, kernel: list[float], mode: str = "same", edge: str = "zero", constant: float = 0.0, step: int = 1, fft: bool | None = None, block: int = 1 << 16, name: str = "filtered") -> DataFrame:
    """idx, name: one long vector with idx 0, 1, 2 ... against the kernel, in every mode and edge of correlate_array.

    The vector is padded as a DataFrame: the places beyond its ends, fewer than
    the kernel has, are joined to the rows that they repeat. Each block of
    results gets the padded rows in its reach, and is one task's work.
    """
    m = len(kernel)
    left, right = pads(m, mode)
    n = (df.agg(F.max(idx)).first()[0] + 1) if df.limit(1).count() else 0
    size = n + left + right - m + 1 if n else 0
    spark, form = df.sparkSession, f"{idx} long, {name} double"
    if size <= 0:
        return spark.createDataFrame([], form)
    rows = df.select((F.col(idx) + left).cast("bigint").alias("__i"), F.col(x).cast("double").alias("__v"))
    beyond = [*range(-left, 0), *range(n, n + right)]
    if EDGES[edge] == "constant":
        ends = spark.createDataFrame([(p + left, constant if edge == "constant" else 0.0) for p in beyond], "__i long, __v double")
    else:
        whole = 2 * n
        source = {"edge": lambda p: min(max(p, 0), n - 1), "wrap": lambda p: p % n, "symmetric": lambda p: min(p % whole, whole - 1 - p % whole)}[EDGES[edge]]
        to = spark.createDataFrame([(p + left, source(p)) for p in beyond], f"__i long, {idx} long")  # fewer rows than the kernel has values
        ends = df.select(idx, F.col(x).cast("double").alias("__v")).join(F.broadcast(to), idx).select("__i", "__v")
    reach = F.sequence(F.greatest(F.floor((F.col("__i") - (m - 1)) / block), F.lit(0)), F.floor(F.col("__i") / block))
    spread = rows.unionByName(ends).withColumn("__b", F.explode(reach))

    def one(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("__i")
        at, v = int(g["__i"].iloc[0]), g["__v"].to_numpy(float)
        out = correlate_array(v, kernel, "valid", fft=fft if fft is not None else m >= 64)
        place = np.arange(at, at + len(out))
        on = (place < min(size, (key[0] + 1) * block)) & (place % step == 0)
        return pd.DataFrame({idx: place[on] // step, name: out[on]})

    return spread.groupBy("__b").applyInPandas(one, form)


def same_long(df: DataFrame, x: str, idx: str, kernel: list[float], edge: str = "zero", block: int = 1 << 16, name: str = "filtered") -> DataFrame:
    """Mode "same" of one long vector with idx 0, 1, 2 ...: as long as the vector."""
    out = correlate_long(df, x, idx, kernel, "same", edge, block=block, name=name)
    return out if len(kernel) % 2 else out.where(F.col(idx) < df.count())


def gauss_kernel(sigma: float, radius: int) -> list[float]:
    """A normalised Gaussian of 2 radius + 1 values."""
    w = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-radius, radius + 1)]
    return [v / sum(w) for v in w]


def gaussian1d(df: DataFrame, x: str, keys: list[str], order: str, sigma: float, mode: str = "same", edge: str = "reflect", truncate: float = 4.0) -> DataFrame:
    return correlate1d(df, x, keys, order, gauss_kernel(sigma, int(truncate * sigma + 0.5)), mode=mode, edge=edge)


def ricker(points: int, a: float) -> list[float]:
    """Samples of the Mexican-hat wavelet of width a."""
    scale = 2 / (math.sqrt(3 * a) * math.pi**0.25)
    at = [i - (points - 1) / 2 for i in range(points)]
    return [scale * (1 - (v / a) ** 2) * math.exp(-(v * v) / (2 * a * a)) for v in at]


def cwt(df: DataFrame, x: str, keys: list[str], order: str, widths: list[float], wavelet=ricker) -> DataFrame:
    """keys, width, pos, value: each vector against the wavelet at each width, not reversed; a vector is one task's work (see cwt_long)."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    head = "".join(f"`{k}` {kinds[k]}, " for k in keys)

    def one(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        v = g.sort_values(order)[x].to_numpy(float)
        out = []
        for width in widths:
            n = min(int(10 * width), len(v))
            c = correlate_array(v, wavelet(n, width), "same")[: len(v)]
            out.append(pd.DataFrame({**{k: [z] * len(c) for k, z in zip(keys, key, strict=True)}, "width": float(width), "pos": np.arange(len(c)), "value": c}))
        return pd.concat(out)

    return df.select(*keys, order, x).groupBy(*keys).applyInPandas(one, f"{head}width double, pos long, value double")


def cwt_long(df: DataFrame, x: str, idx: str, widths: list[float], wavelet=ricker, block: int = 1 << 16) -> DataFrame:
    """width, idx, value: one long vector with idx 0, 1, 2 ... against the wavelet at each width, in blocks."""
    n, out = df.count(), None
    for width in widths:
        points = min(int(10 * width), n)
        some = correlate_long(df, x, idx, wavelet(points, width), "same", block=block, name="value").where(F.col(idx) < n).select(F.lit(float(width)).alias("width"), idx, "value")
        out = some if out is None else out.unionByName(some)
    return out


def gaussian_long(df: DataFrame, x: str, idx: str, sigma: float, edge: str = "reflect", truncate: float = 4.0, block: int = 1 << 16, name: str = "filtered") -> DataFrame:
    """A Gaussian filter of one long vector with idx 0, 1, 2 ..."""
    return correlate_long(df, x, idx, gauss_kernel(sigma, int(truncate * sigma + 0.5)), "same", edge, block=block, name=name)
