"""Substring dedup with difference-cover anchors.

{0, 1, 3} is a difference cover modulo 7: for any two positions some shift of 0
to 6 brings both into the cover. So any 13 words that two documents share hold
an anchor (7 words that start at a cover position) at the same place in both.
Only anchors are exchanged first. Those that occur in more than one document
extend to the windows of 13 words around them, which are exchanged in turn; a
window is a repeat if its words also start in a document with a smaller id.

Both exchanges send entries in packed blocks, one per bucket of hashes. What a
batch can decide alone (an anchor that it holds twice, a window that one of its
own smaller documents has) is decided there, and of each hash only the entries
of the batch's smallest document travel to the bucket. So a passage in a third
of all documents brings to its bucket no more than each batch's own entry.
A batch makes a block a bucket at most, whatever the size of a group; buckets
are two a shuffle partition, or one for 4 MB of input if these are more.

Windows are told apart by two 64-bit hashes that share nothing: one from
polynomials over the bytes of words, one from XXH64 of the words. Entries name
their row by its id, and where rows share an id by a hash of the text as well.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import bounded, drop, scratch
from ._text import _Powers, BLANKS, flat, gram_hashes, gram_places, mix, runs, span_hashes, words
from ._xxh64 import xxh64

WINDOW, PERIOD, COVER = 13, 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
_U = np.uint64
_SECOND = _Powers(0x8EBC6AF09C88C6E3)
#: A bucket's entries: hashes, ids, text hashes, places, whether two documents have them; and those that are repeats already.
_BLOCK = "bucket int, h binary, g binary, d binary, t binary, p binary, k binary, rd binary, rt binary, rp binary"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _second(hashes: np.ndarray, n: int) -> np.ndarray:
    """Another hash of runs of n words, by hashes of words that are independent of span_hashes."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, _U)
    up, down = _SECOND.get(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, dtype=_U)
    np.cumsum(mix(hashes) * up[:-1], out=sums[1:])
    return mix((sums[n:] - sums[:m]) * down[:m])


def _anchors(raw: np.ndarray, offs: np.ndarray, near: None = None) -> tuple[np.ndarray, ...]:
    """Text, place, hash and 0 for every anchor."""
    starts, ends, first = words(raw, offs, BLANKS)
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(len(starts)) - first[of]
    ok = gram_places(first, ANCHOR, len(starts))
    ok &= np.isin(np.arange(PERIOD), COVER)[at[: len(ok)] % PERIOD]
    on = np.flatnonzero(ok)
    hashes = gram_hashes(span_hashes(raw, starts, ends), ANCHOR)
    return of[on], at[on], hashes[on], np.zeros(0, _U)


def _windows(raw: np.ndarray, offs: np.ndarray, near: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Text, place and both hashes of every window that holds one of the anchors near[text]."""
    starts, ends, first = words(raw, offs, BLANKS)
    n = len(starts)
    flags = np.zeros(n + 1, dtype=bool)
    for i, places in enumerate(near):
        places = places[places < first[i + 1] - first[i]]
        if len(places):
            spread = (places[:, None] - np.arange(PERIOD)).ravel()
            flags[first[i] + spread[spread >= 0]] = True
    whole = gram_places(first, WINDOW, n)
    on = np.flatnonzero(flags[: len(whole)] & whole)
    of = np.searchsorted(first, on, "right") - 1
    return of, on - first[of], gram_hashes(span_hashes(raw, starts, ends), WINDOW)[on], _second(xxh64(raw, starts, ends, WINDOW), WINDOW)[on]


def _blocks(ids: np.ndarray, texts: np.ndarray, at: np.ndarray, h: np.ndarray, g: np.ndarray, buckets: int, strict: bool) -> Iterator[pa.RecordBatch]:
    """A batch's entries by bucket. strict: only entries whose hash a smaller document has are repeats, else all whose hash two documents have."""
    if not len(h):
        return
    order = np.lexsort((ids, h))
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[order][1:] != h[order][:-1]
    if len(g):  # the second hash only tells apart what the first does not
        apart = g[order][1:] != g[order][:-1]
        if np.any(apart & ~new[1:]):
            order = np.lexsort((ids, g, h))
            apart = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
        new[1:] |= apart
    ids, texts, at, h, g = ids[order], texts[order], at[order], h[order], g[order] if len(g) else g
    heads = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    later = ids > ids[heads][group]
    both = np.zeros(len(heads), dtype=bool)
    both[group[later]] = True  # two documents of this batch have it
    send, done = ~later, later
    known = both[group] & send
    bucket = ((h >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
    put = np.where(done, (mix(ids.view(_U)) >> _U(32)) * _U(buckets) >> _U(32), bucket.astype(_U)).astype(np.int64)
    by = np.lexsort((at, ids, put))
    ids, texts, at, h, put, send, known = ids[by], texts[by], at[by].astype(np.int32), h[by], put[by], send[by], known[by] & (not strict)
    g = g[by] if len(g) else g
    cuts = np.flatnonzero(np.concatenate([[True], put[1:] != put[:-1]]))
    rows = []
    for a, b in zip(cuts, np.append(cuts[1:], len(put)), strict=True):
        s, r = np.flatnonzero(send[a:b]) + a, np.flatnonzero(~send[a:b]) + a
        parts = (h[s], g[s] if len(g) else g, ids[s], texts[s], at[s], known[s], ids[r], texts[r], at[r])
        rows.append((int(put[a]), *(x.tobytes() for x in parts)))
    cols = list(zip(*rows, strict=True))
    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], [x.split()[0] for x in _BLOCK.split(", ")])


def _settle(table: pa.Table, strict: bool) -> pa.Table:
    """The repeats of one bucket."""
    kinds = {"h": _U, "g": _U, "d": np.int64, "t": np.int64, "p": np.int32, "k": bool, "rd": np.int64, "rt": np.int64, "rp": np.int32}
    h, g, d, t, p, k, rd, rt, rp = (np.frombuffer(b"".join(table[n].to_pylist()), kind) for n, kind in kinds.items())
    g = g if len(g) else np.zeros(len(h), _U)
    order = np.lexsort((d, g, h))
    h, g, d, t, p, k = h[order], g[order], d[order], t[order], p[order], k[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    heads, group = np.flatnonzero(new), np.cumsum(new) - 1
    later = d > d[heads][group] if len(h) else np.zeros(0, bool)
    if not strict:
        both = np.zeros(len(heads), dtype=bool)
        both[group[later | k]] = True
        later = both[group] if len(h) else later
    return pa.table({"id": np.concatenate([d[later], rd]), "t": np.concatenate([t[later], rt]), "at": np.concatenate([p[later], rp])})


def _exchange(blocks: DataFrame, strict: bool) -> DataFrame:
    return blocks.groupBy("bucket").applyInArrow(lambda t: _settle(t, strict), "id long, t long, at int")


@contextlib.contextmanager
def _swept(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a finished execution are removed at once."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before) if before is not None else spark.conf.unset(_CLEAN)


def _written(df: DataFrame, path: str) -> DataFrame:
    """The rows as a table in the shared folder; what led to it can be dropped."""
    with _swept(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _emit(df: DataFrame, cut, buckets: int, strict: bool) -> DataFrame:
    """Blocks of the entries that cut() finds in id, t, text (and near)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, (data, offs) = b.column(0).to_numpy(), b.column(1).to_numpy(), flat(b.column(2))
            near = [np.asarray(x, dtype=np.int64) for x in b.column(3).to_pylist()] if b.num_columns > 3 else None
            for group in runs(offs, 1 << 23):
                got: list[tuple[np.ndarray, ...]] = []
                for i, j in runs(offs[group[0] : group[1] + 1]):
                    i, j = i + group[0], j + group[0]
                    of, at, h, g = cut(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], near[i:j] if near else None)
                    got.append((ids[i:j][of], texts[i:j][of], at, h, g))
                yield from _blocks(*(np.concatenate(x) for x in zip(*got, strict=True)), buckets, strict)

    return df.mapInArrow(scan, _BLOCK)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, t, text: t tells rows apart that share an id; 0 where no id has two texts."""
    src = bounded(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    own = F.coalesce(F.xxhash64("text"), F.lit(0))
    known = src.where("id is not null and text is not null")
    twice = known.groupBy("id").agg(F.min(own).alias("a"), F.max(own).alias("b")).where("a <> b").limit(1).count()
    return src.select("id", (own if twice else F.lit(0)).cast("long").alias("t"), "text")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, t (a hash of the text if some id has two texts, else 0), at: the windows (place of the first word, from 0) whose words also start in a document with a smaller id."""
    return _repeats(_rows(docs, id_col, text_col), docs)


def _repeats(rows: DataFrame, docs: DataFrame) -> DataFrame:
    spark, src = rows.sparkSession, rows.where("id is not null and text is not null")
    plan = docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    buckets = min(1 << 20, max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), int(str(plan)) >> 22))
    path = scratch(spark, "anchors")
    anchors = _written(_exchange(_emit(src, _anchors, buckets, False), False), path)
    near = anchors.groupBy("id", "t").agg(F.collect_set("at").alias("near"))  # bounded by the length of one text
    hit = src.join(near, ["id", "t"]).select("id", "t", "text", "near")
    windows = _written(_exchange(_emit(hit, _windows, buckets, True), True), scratch(spark, "windows"))
    drop(spark, path)
    return windows


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_words, n_removed, kept (the words left, one blank between).

    Words are runs without blanks, unchanged. A word goes if a window of 13
    words that covers it also starts in a document with a smaller id. Null and
    empty texts have no words. Rows with a null id keep all and take nothing
    from others. Ids are integers; rows that share one are judged each by its
    own text, and never by each other. An empty table gives no rows. Other
    columns are ignored.
    """
    src = _rows(docs, id_col, text_col)
    gone = _repeats(src, docs).groupBy("id", "t").agg(F.collect_set("at").alias("at"))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = flat(b.column(1))
            gone = [np.asarray(x or [], dtype=np.int64) for x in b.column(2).to_pylist()]
            for i, j in runs(offs):
                raw = data[offs[i] : offs[j]]
                starts, ends, first = words(raw, offs[i : j + 1] - offs[i], BLANKS)
                edge = np.zeros(len(starts) + WINDOW + 1, dtype=np.int32)
                for t in range(i, j):
                    at = gone[t] + first[t - i]
                    edge[at] += 1
                    edge[at + WINDOW] -= 1
                out = np.cumsum(edge)[: len(starts)] > 0
                mark = np.zeros(len(raw) + 1, dtype=np.int8)  # bytes of words that stay
                mark[starts[~out]] += 1
                mark[ends[~out]] -= 1
                keep = np.cumsum(mark, dtype=np.int8)[:-1] > 0
                lone = ends[~out][ends[~out] < len(raw)]
                blank = lone[BLANKS[raw[lone]]]
                keep[blank] = True
                line = raw[keep]
                line[BLANKS[line]] = 0x20
                line, size = line.tobytes(), np.concatenate([[0], np.cumsum(keep)])[offs[i : j + 1] - offs[i]]
                kept = [line[size[t] : size[t + 1]].rstrip(b" ") for t in range(j - i)]
                lost = np.concatenate([[0], np.cumsum(out)])[first]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(first)), pa.array(np.diff(lost)), pa.array(kept, pa.binary()).cast(pa.string())], [id_col, "n_words", "n_removed", "kept"])

    return src.join(gone, ["id", "t"], "left").select("id", "text", "at").mapInArrow(rest, f"`{id_col}` long, n_words long, n_removed long, kept string")
