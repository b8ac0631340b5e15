"""SimHash near-duplicates by a generalised pigeonhole search.

Fingerprints of 64 bits are cut into parts of correlated bits. Two that differ
in at most ``radius`` bits agree up to t_i bits in some part i whenever the t_i
add up to radius - parts + 1 (a part with t_i = -1 is not looked at). A dynamic
program picks the t_i that cost least, by the count of probes and by candidate
counts estimated from the bits of all fingerprints. Each fingerprint is filed
under its own value in each part, probes the values up to t_i bits away that
are larger than its own (so that a pair meets once), and whatever meets is
verified on all 64 bits inside the join.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import bounded, stage
from ._text import BLANKS, LOWER, flat, runs, words
from ._xxh64 import xxh64
from .components import components

_U = np.uint64
#: For each byte its 8 bits, the first in the lowest byte, as one 64-bit number.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).copy().view("<u8").ravel()
SEED, SHINGLE, RADIUS = 42, 3, 3


def fingerprint(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text, from the hashes first[i]:first[i+1], the bits that over half of them have."""
    counts = np.diff(first)
    pieces = (counts + 254) // 255  # sums of up to 255 ones fit in a byte
    head = np.concatenate([[0], np.cumsum(pieces)])
    out = np.zeros(len(counts), dtype=_U)
    if not len(hashes):
        return out
    step = np.arange(head[-1]) - np.repeat(head[:-1], pieces)
    cuts = np.repeat(first[:-1], pieces) + 255 * step
    octets = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    sums = np.stack([np.add.reduceat(_SPREAD[octets[:, k]], cuts) for k in range(8)], axis=1)
    ones = sums.view(np.uint8).reshape(-1, 64).astype(np.int64)
    full = np.flatnonzero(counts)
    total = np.add.reduceat(ones, head[:-1][full], axis=0)
    out[full] = np.packbits(total * 2 > counts[full, None], axis=1).view(">u8").ravel()
    return out


def shingle_hashes(raw: np.ndarray, at: np.ndarray, shingle: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles of the lower-cased texts at[i]:at[i+1], and the number of each text's first (one more at the end)."""
    starts, ends, first = words(raw, at, BLANKS)
    if not len(starts):
        return np.zeros(0, dtype=_U), np.zeros(len(at), dtype=np.int64)
    keep = ~BLANKS[raw]
    after = ends[ends < len(raw)]
    keep[after[BLANKS[raw[after]]]] = True  # one blank after each word
    place = np.cumsum(keep) - 1
    joined = raw[keep]
    joined[BLANKS[joined]] = 0x20
    count = np.diff(first)
    width = np.minimum(count, shingle)
    of_text = np.repeat(width, count)  # of each word
    left = np.repeat(first[1:], count) - np.arange(len(starts))
    heads = np.flatnonzero(left >= of_text)
    lasts = heads + of_text[heads] - 1
    return xxh64(joined, place[starts[heads]], place[ends[lasts] - 1] + 1, seed), np.searchsorted(heads, first)


def fingerprints_of(texts: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The 64-bit SimHash of each text of a string column."""
    data, offs = flat(texts)
    out = np.zeros(len(offs) - 1, dtype=_U)
    for i, j in runs(offs):
        out[i:j] = fingerprint(*shingle_hashes(LOWER[data[offs[i] : offs[j]]], offs[i : j + 1] - offs[i], shingle, seed))
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """id_col and fp (the SimHash as a signed long) of every row."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array(fingerprints_of(b.column(1), shingle, seed).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), fp], [id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(compute, f"`{id_col}` {kind}, fp long")


# the search


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def _gather(fp: np.ndarray, positions: list[int]) -> np.ndarray:
    """The bits at the positions (0 is the highest), as a number."""
    out = np.zeros(len(fp), dtype=_U)
    for p in positions:
        out = (out << _U(1)) | ((fp >> _U(63 - p)) & _U(1))
    return out


def correlated_parts(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in groups of near-equal size whose members are correlated; together[i, j]: fingerprints with both bits."""
    p = np.diag(together) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    like = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(like, 0)
    free, out = list(range(64)), []
    for k in range(parts, 0, -1):
        size, group = len(free) // k, [free.pop(int(np.argmax(like[np.ix_(free, free)].sum(1))))]
        while len(group) < size:
            group.append(free.pop(int(np.argmax(like[np.ix_(free, group)].sum(1)))))
        out.append(group)
    return out


def within(counts: np.ndarray, width: int, radius: int) -> np.ndarray:
    """The share of pairs of values at each distance up to radius, from the counts of the values."""
    p = counts / max(counts.sum(), 1)
    at = np.arange(len(p))
    return np.array([sum(float(p @ p[at ^ sum(1 << b for b in flip)]) for flip in combinations(range(width), e)) for e in range(radius + 1)])


def allocate(costs: list[list[float]], total: int) -> list[int]:
    """The thresholds, from -1 up, that add up to total at the least cost; costs[i][t + 1]."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for k, more in enumerate(row):
                if s + k - 1 not in new or c + more < new[s + k - 1][0]:
                    new[s + k - 1] = (c + more, [*ts, k - 1])
        best = new
    return best[total][1]


def _plan(distinct: DataFrame, radius: int, parts: int) -> tuple[list[list[int]], list[int]]:
    """The parts and their thresholds, from counts over all fingerprints; what reaches the driver has a fixed size."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((64, 64)), 0
        for b in batches:
            bits = _bits(b.column(0).to_numpy().view(_U)).astype(np.float32)
            for i in range(0, len(bits), 1 << 16):
                both += bits[i : i + (1 << 16)].T @ bits[i : i + (1 << 16)]
            n += len(bits)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097)), pa.array(np.append(both.ravel(), n))], ["k", "c"])

    got = np.zeros(4097)
    for k, c in distinct.select("fp").mapInArrow(pairs, "k long, c double").groupBy("k").agg(F.sum("c")).collect():
        got[k] = c
    n = int(got[-1])
    groups = correlated_parts(got[:-1].reshape(64, 64), n, parts)
    subs = [(i, g[j : j + 16]) for i, g in enumerate(groups) for j in range(0, len(g), 16)]

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(subs), 1 << 16), dtype=np.int64)
        for b in batches:
            fp = b.column(0).to_numpy().view(_U)
            for s, (_, at) in enumerate(subs):
                counts[s] += np.bincount(_gather(fp, at).astype(np.int64), minlength=1 << 16)
        k = np.flatnonzero(counts.ravel())
        if len(k):
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(counts.ravel()[k])], ["k", "c"])

    hist = np.zeros(len(subs) << 16)
    seen = distinct.select("fp").mapInArrow(values, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).toArrow()
    hist[seen["k"].to_numpy()] = seen["c"].to_numpy()
    costs = []
    for i, g in enumerate(groups):
        share = np.array([1.0])
        for s, (of, at) in enumerate(subs):
            if of == i:
                share = np.convolve(share, within(hist[s << 16 : (s + 1) << 16], len(at), radius))[: radius + 1]
        reach = np.cumsum(share) * n * n / 2
        probes = np.cumsum([comb(len(g), e) for e in range(radius + 1)]) * n / 2
        costs.append([0.0, *(reach + 4 * probes)])
    return groups, allocate(costs, radius - parts + 1)


def links(distinct: DataFrame, radius: int = RADIUS, parts: int = 2) -> DataFrame:
    """u, v: the ids of all pairs of fingerprints that differ in at most radius bits.

    distinct: id long and fp long, each fingerprint once. A pair may come twice.
    """
    groups, bounds = _plan(distinct, radius, parts)

    def emit(batches: Iterator[pa.RecordBatch], probing: bool) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, fps = b.column(0).to_numpy(), b.column(1).to_numpy()
            for at in range(0, len(ids), 1 << 14):
                i, f = ids[at : at + (1 << 14)], fps[at : at + (1 << 14)]
                for part, (g, t) in enumerate(zip(groups, bounds, strict=True)):
                    if t < 0:
                        continue
                    own = _gather(f.view(_U), g)
                    for e in range(t + 1 if probing else 1):
                        for flip in combinations(range(len(g)), e):
                            to = own ^ _U(sum(1 << x for x in flip))
                            ok = to >= own
                            n = int(ok.sum())
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(n, part, np.int32)), pa.array(to[ok].view(np.int64)), pa.array(i[ok]), pa.array(f[ok]), pa.array(np.full(n, e == 0))],
                                ["part", "key", "id", "fp", "own"],
                            )

    form = "part int, key long, id long, fp long, own boolean"
    src = distinct.select("id", "fp")
    filed = src.mapInArrow(lambda it: emit(it, False), form).select("part", "key", F.col("id").alias("v"), F.col("fp").alias("fv"))
    asked = src.mapInArrow(lambda it: emit(it, True), form).select("part", "key", F.col("id").alias("u"), F.col("fp").alias("fu"), "own")
    near = (F.bit_count(F.col("fu").bitwiseXOR(F.col("fv"))) <= radius) & (~F.col("own") | (F.col("u") < F.col("v")))
    return asked.alias("a").join(filed.alias("f"), (F.col("a.part") == F.col("f.part")) & (F.col("a.key") == F.col("f.key")) & near).select("u", "v")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, parts: int = 2) -> DataFrame:
    """One row per document: id_col, fingerprint (16 hex digits), component_id.

    Words are runs without blanks after lower-casing A-Z; shingles of three
    words count as often as they occur. A text of fewer words is one shingle,
    one without words (null, empty) has fingerprint zero and is linked like any
    other. Repeated rows stay; component_id is the smallest id that can be
    reached. Ids are integers; a row with a null id takes the component of its
    fingerprint (null if no other row has it). An empty table gives no rows.
    Other columns are ignored, whatever their names.
    """
    marked = stage(fingerprints(bounded(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))), "id", "text"))
    distinct = stage(marked.where("id is not null").groupBy("fp").agg(F.min("id").alias("id")))
    reached = components(links(distinct, radius, parts))
    classes = distinct.join(reached, distinct["id"] == reached["node"], "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return marked.join(classes, "fp", "left").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, share: tuple[int, int] = (4, 5)) -> DataFrame:
    """The rows of docs, all columns, without near-duplicates: of each group the document with the smallest id stays, once.

    A group is linked by a Jaccard similarity of at least share between sets of
    shingles: fingerprints that are near first, each verified on the sets, then
    what they miss, without loss (see overlap). Texts without words are alike.
    Each row is judged by its own text, also where rows share an id or have
    none; a row without an id stays only if none with one is in its group, and
    rows with neither an id nor words all stay.
    """
    from .overlap import copies

    docs = bounded(docs)
    found = stage(copies(docs, id_col, text_col, shingle, share))

    def of(rows: DataFrame) -> tuple[DataFrame, Column]:
        return rows.select(F.col("id").alias("__id"), F.col("tag").alias("__tag")), F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__tag"))

    out = docs.join(*of(found.where("not first and not lone")), "left_anti")
    twice = found.where("first and not lone").groupBy("id", "tag").count().where("count > 1")
    if twice.limit(1).count():
        twice = stage(twice)
        once = out.join(*of(twice), "left_semi").withColumn("__tag", F.xxhash64(text_col)).dropDuplicates([id_col, "__tag"])
        out = out.join(*of(twice), "left_anti").unionByName(once.drop("__tag"))
    return out
