"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors are brought to length one and rotated so that the coordinates with the
most variance come first (the rotation comes from the covariance of all rows
and changes no product). Equal vectors are compared once. The rest are cut into
bands along the first direction, and each pair of bands is one task's work, in
tiles. A tile first sums the products of the leading coordinates, in single
precision; what the others can still add is bounded by the product of the
suffix norms, and only pairs that can still reach the threshold go on to the
next coordinates. Survivors are decided by the full product of the original
vectors in double precision. Two bands whose boxes of leading coordinates are
too far apart are not compared at all.

A band holds BAND_BYTES of vectors, and there are as few bands as that allows,
at least LEAST_BANDS: with b bands each vector travels b times for b (b + 1) / 2
tasks. The pairs of bands are planned in a DataFrame. A task returns counts of
links and a forest that connects what is linked, not the pairs, so a group of
near copies costs no more output than its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import bounded, stage
from .components import components

THRESHOLD, BAND_BYTES, LEAST_BANDS, TILE = 0.9, 48 << 20, 3, 512
#: The leading coordinates that boxes are kept for, and a margin for rounding in single precision, with what each coordinate adds.
_BOX, _SLACK, _MORE = 8, 1e-5, 1.3e-7


def _packed(column: pa.ListArray, kind: type) -> pa.Array:
    """Each vector as the bytes of its numbers; null where it can't be linked."""
    raw = column.values.to_numpy(zero_copy_only=False).astype(kind, copy=False) + kind(0)  # -0 is 0; null is NaN
    offs = column.offsets.to_numpy().astype(np.int64)
    size = np.diff(offs)
    edge = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    bad, some = edge(~np.isfinite(raw)), edge(raw != 0)
    good = (bad[offs[1:]] == bad[offs[:-1]]) & (some[offs[1:]] > some[offs[:-1]]) & column.is_valid().to_numpy(zero_copy_only=False)
    held = np.ascontiguousarray(raw[np.repeat(good, size)] if len(size) and offs[0] == 0 and offs[-1] == len(raw) else np.concatenate([raw[:0], *(raw[a:b] for a, b, on in zip(offs[:-1], offs[1:], good, strict=True) if on)]))
    upto = np.concatenate([[0], np.cumsum(size * good)]) * raw.itemsize
    return pa.Array.from_buffers(pa.binary(), len(size), [pa.array(good).buffers()[1], pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(held)], int((~good).sum()))


def _matrix(column: pa.Array | pa.ChunkedArray, kind: type, size: int) -> np.ndarray:
    """The numbers of a column of _packed vectors of one size."""
    parts = [np.frombuffer(c.buffers()[2], kind)[c.offset * size : (c.offset + len(c)) * size] for c in (column.chunks if isinstance(column, pa.ChunkedArray) else [column]) if len(c)]
    return np.concatenate(parts).reshape(-1, size) if parts else np.zeros((0, size), kind)


def _units(x: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision, safe against overflow and underflow."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return x


def _turned(raw: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """The rotated unit rows in single precision, some at a time."""
    out = np.empty((len(raw), turn.shape[1]), np.float32)
    for k in range(0, len(raw), 1 << 13):
        out[k : k + (1 << 13)] = _units(raw[k : k + (1 << 13)]) @ turn
    return out


def _rotation(vectors: DataFrame, size: int, kind: type) -> np.ndarray:
    """Directions of falling variance, from sums over all rows; what reaches the driver is size^2 numbers."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for b in batches:
            if b.num_rows:
                u = _units(_matrix(b.column(0), kind, size))
                total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size)), pa.array(total.ravel())], ["k", "c"])

    cov = np.zeros(size * size)
    for k, c in vectors.select("vec").mapInArrow(sums, "k long, c double").groupBy("k").agg(F.sum("c")).toLocalIterator():
        cov[k] = c
    return np.linalg.eigh(cov.reshape(size, size))[1][:, ::-1].copy()


class _Forest:
    """Union-find over a task's own vectors, many pairs at a time."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        top = self.up[at]
        while not np.array_equal(top, up := self.up[top]):
            top = up
        self.up[at] = top
        return top

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            on = a != b
            a, b = np.maximum(a[on], b[on]), np.minimum(a[on], b[on])
            self.up[a] = b  # one of a root's smaller partners; the others in later rounds


def _close(left: np.ndarray, right: np.ndarray, threshold: float, steps: list[int], same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rotated rows whose product may be threshold or more."""
    norms = [[np.sqrt(np.einsum("ij,ij->i", x[:, s:], x[:, s:])) for x in (left, right)] for s in steps]
    first, threshold = steps[0], threshold - _SLACK - _MORE * steps[-1]
    for a in range(0, len(left), TILE):
        for b in range(a if same else 0, len(right), 4 * TILE):
            la, rb = slice(a, a + TILE), slice(b, b + 4 * TILE)
            head = left[la, :first] @ right[rb, :first].T
            head += norms[0][0][la, None] * norms[0][1][None, rb]
            i, j = np.nonzero(head >= threshold)
            i, j = i + a, j + b
            if same:
                i, j = i[i < j], j[i < j]
            part = np.einsum("ij,ij->i", left[i, :first], right[j, :first]) if len(i) else np.zeros(0)
            for s, (nl, nr), before in zip(steps[1:], norms[1:], steps[:-1], strict=True):
                part = part + np.einsum("ij,ij->i", left[i, before:s], right[j, before:s])
                on = part + nl[i] * nr[j] >= threshold
                i, j, part = i[on], j[on], part[on]
            if len(i):
                yield i, j


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, band_bytes: int = BAND_BYTES, least_bands: int = LEAST_BANDS) -> DataFrame:
    """One row per row: id_col, n_links (other rows linked directly), component_id, kept.

    Cosines are taken in double precision; rows are linked at threshold or
    more. A vector that is null, empty, zero, or holds a null or a number that
    is not finite links with nothing, not even its like. Vectors of different
    lengths are not linked. Equal vectors are linked with each other. Ids are
    integers; rows that share an id are rows of their own in n_links. An empty
    table gives no rows. Other columns, labels among them, are ignored,
    whatever their names.
    """
    single = vectors.schema[vec_col].dataType.elementType.typeName() == "float"
    kind = np.float32 if single else np.float64

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _packed(b.column(1), kind)], ["id", "vec"])

    rows = bounded(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(f"array<{'float' if single else 'double'}>").alias("v")))
    rows = stage(rows.mapInArrow(pack, "id long, vec binary"))
    key = F.sha2("vec", 256)  # stands for the vector where only its class is asked for
    distinct = rows.where("vec is not null").groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    distinct = stage(distinct.withColumn("size", (F.octet_length("vec") / np.dtype(kind).itemsize).cast("int")))
    found = None
    for size, n in distinct.groupBy("size").count().collect():  # a table of embeddings has one size, or a few
        some = _compare(distinct.where(F.col("size") == size), size, n, kind, threshold, band_bytes, least_bands)
        found = some if found is None else found.union(some)
    if found is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = stage(found)
    degree = found.groupBy("id").agg(F.sum("n").alias("others"))
    group = components(found.select(F.col("id").alias("u"), F.col("to").alias("v")))
    classes = distinct.select(key.alias("key"), "id", "copies").join(degree, "id", "left").join(group, F.col("id") == F.col("node"), "left")
    classes = classes.select("key", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = rows.select("id", key.alias("key")).join(classes, "key", "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id").eqNullSafe(F.col("component_id"))).alias("kept"))


def _compare(distinct: DataFrame, size: int, n: int, kind: type, threshold: float, band_bytes: int, least_bands: int) -> DataFrame:
    """id, n (rows linked), to (a vector of the same component) for each vector that a task found links for."""
    turn = _rotation(distinct, size, kind)
    bands = min(n, max(least_bands, -(-n * size * np.dtype(kind).itemsize // band_bytes)))
    steps = sorted({min(size, s) for s in (max(8, size // 4), max(16, size // 2), size)})
    placed = _banded(distinct, turn, kind, bands, -(-n // bands))
    plan = _pairs(placed, turn, kind, np.sqrt(max(0.0, 2 - 2 * threshold)) + _SLACK)

    def tile(table: pa.Table) -> pa.Table:
        a, b = table["a"][0].as_py(), table["b"][0].as_py()
        of, ids, copies = (table[c].to_numpy() for c in ("band", "id", "copies"))
        raw = _matrix(table["vec"], kind, size)
        turned = _turned(raw, turn)
        l, r = np.flatnonzero(of == a), np.flatnonzero(of == b)
        forest, links = _Forest(len(ids)), np.zeros(len(ids), dtype=np.int64)
        for i, j in _close(turned[l], turned[r], threshold, steps, a == b):
            for k in range(0, len(i), 1 << 15):
                x, y = l[i[k : k + (1 << 15)]], r[j[k : k + (1 << 15)]]
                on = np.einsum("ij,ij->i", _units(raw[x]), _units(raw[y])) >= threshold
                x, y = x[on], y[on]
                np.add.at(links, x, copies[y])
                np.add.at(links, y, copies[x])
                forest.join(x, y)
        on = np.flatnonzero(links)
        return pa.table({"id": ids[on], "n": links[on], "to": ids[forest.roots(on)]})

    return placed.join(plan, "band").groupBy("a", "b").applyInArrow(tile, "id long, n long, to long")


def _banded(distinct: DataFrame, turn: np.ndarray, kind: type, bands: int, most: int) -> DataFrame:
    """id, vec, copies, band: neighbours along the first direction, some ``most`` rows each."""
    size = len(turn)

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_units(_matrix(b.column(1), kind, size)) @ turn[:, 0])], ["id", "vec", "copies", "x"])

    led = distinct.select("id", "vec", "copies").mapInArrow(lead, "id long, vec binary, copies long, x double")
    cuts = led.approxQuantile("x", [k / bands for k in range(1, bands)], 0.25 / bands) if bands > 1 else []

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.searchsorted(cuts, b.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(at.astype(np.int32))], ["id", "vec", "copies", "strip"])

    strips = led.mapInArrow(put, "id long, vec binary, copies long, strip int")
    first, plan = 0, []
    for strip, count in sorted(strips.groupBy("strip").count().collect()):  # one row a strip; vectors of one direction can fill a strip: it is split
        plan.append((strip, first, max(1, -(-2 * count // (3 * most)))))
        first += plan[-1][2]
    splits = F.broadcast(distinct.sparkSession.createDataFrame(plan, "strip int, first int, parts int"))  # 12 bytes a band
    return strips.join(splits, "strip").select("id", "vec", "copies", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("band"))


def _pairs(placed: DataFrame, turn: np.ndarray, kind: type, reach: float) -> DataFrame:
    """band, a, b: the pairs a <= b of bands whose boxes of leading coordinates are near enough, under both of their bands."""
    size, box = len(turn), min(_BOX, len(turn))

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo: dict[int, np.ndarray] = {}
        hi: dict[int, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                x, of = _units(_matrix(b.column(0), kind, size)) @ turn[:, :box], b.column(1).to_numpy()
                for k in np.unique(of).tolist():
                    y = x[of == k]
                    lo[k] = np.minimum(lo.get(k, np.inf), y.min(0))
                    hi[k] = np.maximum(hi.get(k, -np.inf), y.max(0))
        for k in lo:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(box, k, np.int32)), pa.array(np.arange(box, dtype=np.int32)), pa.array(lo[k]), pa.array(hi[k])], ["band", "k", "lo", "hi"])

    rows = placed.select("vec", "band").mapInArrow(bounds, "band int, k int, lo double, hi double").groupBy("band", "k").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    boxes = stage(rows.groupBy("band").agg(F.sort_array(F.collect_list(F.struct("k", "lo", "hi"))).alias("box")))  # box entries a band
    count = boxes.agg(F.max("band")).first()[0] + 1
    left = boxes.select(F.col("band").alias("a"), F.col("box").alias("p"), F.explode(F.sequence("band", F.lit(count - 1))).alias("b"))
    gap = lambda x, y: F.greatest(F.lit(0.0), x["lo"] - y["hi"], y["lo"] - x["hi"])
    far = F.aggregate(F.zip_with("p", "q", lambda x, y: gap(x, y) * gap(x, y)), F.lit(0.0), lambda s, g: s + g)
    near = left.join(boxes.select(F.col("band").alias("b"), F.col("box").alias("q")), "b").where(far <= reach * reach).select("a", "b")
    return near.select(F.col("a").alias("band"), "a", "b").union(near.where("a < b").select(F.col("b").alias("band"), "a", "b"))
