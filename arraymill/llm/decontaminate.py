"""Benchmark decontamination by winnowing.

Of every ``window`` words in a row the smallest hash of ``k`` words is kept, in
the documents and in the benchmark alike, so a span of ``window`` words that
both share has a kept hash in common. Kept hashes are joined; around each hit
the windows are extended word by word and verified. Items shorter than a window
are one window of their own length, looked up by its hash.

If the benchmark's texts are below ``broadcast_bytes`` (measured first), its
windows travel to the documents as flat sorted arrays of some four times its
size, made once, and no document is shuffled. Beyond, kept hashes, then window
hashes of documents that were hit, are joined by shuffle; what no benchmark can
have, by a table of bits of a fixed size, does not enter it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bits import merged
from ._store import bounded
from ._text import LOWER, NOT_ALNUM, flat, gram_hashes, gram_places, runs, span_hashes, words

WINDOW, K, BROADCAST_BYTES = 10, 5, 8 << 20
_U = np.uint64
#: Spans are half-open runs of words, counted from 0.
SPANS = "array<struct<first:int,past:int>>"
#: Bits of the tables that tell what the benchmark may have, and hits that are verified at a time.
_MARKS, _HITS = 24, 1 << 12


class Words:
    """The words of a run of texts with the hashes that the method needs."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray) -> None:
        self.raw = LOWER[raw]
        self.starts, self.ends, self.first = words(self.raw, offs, NOT_ALNUM)
        self.hashes = span_hashes(self.raw, self.starts, self.ends)
        self._bytes: bytes | None = None

    def winnow(self, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Flags of the words whose k-gram is kept, and all k-gram hashes."""
        grams = gram_hashes(self.hashes, k)
        many = window - k + 1
        whole = np.flatnonzero(gram_places(self.first, window, len(self.hashes)))
        kept = np.zeros(len(grams), dtype=bool)
        if len(whole):
            least = grams[whole].copy()
            for i in range(1, many):
                np.minimum(least, grams[whole + i], out=least)
            for i in range(many):
                kept[whole[grams[whole + i] == least] + i] = True
        return kept, grams

    def text(self, at: int, n: int) -> bytes:
        if self._bytes is None:
            self._bytes = self.raw.tobytes()
        return b" ".join([self._bytes[self.starts[i] : self.ends[i]] for i in range(at, at + n)])


def same_words(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """Flags of the pairs of word a[i] and word b[j] that have the same bytes."""
    size = a.ends[i] - a.starts[i]
    same = size == b.ends[j] - b.starts[j]
    on = np.flatnonzero(same)
    if len(on):
        n = size[on]
        first = np.cumsum(n) - n
        step = np.arange(int(n.sum())) - np.repeat(first, n)
        apart = a.raw[np.repeat(a.starts[i[on]], n) + step] != b.raw[np.repeat(b.starts[j[on]], n) + step]
        same[on] = ~np.logical_or.reduceat(apart, first)
    return same


class Benchmark:
    """All windows of the benchmark: for each length their hashes in order, with each one's first word and item."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int, k: int) -> None:
        self.window, self.k, self.names = window, k, [name for name, _ in items]
        self.words = w = Words(*flat(pa.array([text for _, text in items], pa.string())))
        count, self.tables = np.diff(w.first), {}
        of = np.repeat(np.arange(len(count)), count)
        for n in np.unique(np.minimum(count, window)).tolist():
            if n:
                inside = gram_places(w.first, n, len(w.hashes))
                at = np.flatnonzero(inside & (np.minimum(count, window)[of[: len(inside)]] == n))
                hashes = gram_hashes(w.hashes, n)[at]
                order = np.argsort(hashes, kind="stable")
                self.tables[n] = hashes[order], at[order].astype(np.int32), of[at[order]].astype(np.int32)
        flags, grams = w.winnow(window, k)
        self.kept = np.unique(grams[flags])

    def places(self, w: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Length, starts and items (by number) of all occurrences of windows in the texts; a start comes once for each item."""
        for n, (hashes, first, item) in self.tables.items():
            own = gram_hashes(w.hashes, n)
            if n < self.window:
                at = np.flatnonzero(gram_places(w.first, n, len(w.hashes)) & is_in(own, hashes)) if len(own) else np.zeros(0, np.int64)
            else:
                flags, grams = w.winnow(self.window, self.k)
                hit = np.flatnonzero(flags)
                at = extended(w, hit[is_in(grams[hit], self.kept)], self.window, self.k)
                at = at[is_in(own[at], hashes)]
            for p in range(0, len(at), _HITS):
                some = at[p : p + _HITS]
                lo, hi = np.searchsorted(hashes, own[some], "left"), np.searchsorted(hashes, own[some], "right")
                many = hi - lo
                upto = np.cumsum(many)
                for a, b in runs(np.concatenate([[0], upto]), _HITS):  # a window can be in very many items
                    rows = np.repeat(np.arange(a, b), many[a:b])
                    entry = np.arange(len(rows)) - np.repeat(upto[a:b] - many[a:b] - (upto[a - 1] if a else 0), many[a:b]) + lo[rows]
                    step = np.tile(np.arange(n), len(rows))
                    good = same_words(w, np.repeat(some[rows], n) + step, self.words, np.repeat(first[entry], n) + step)
                    good = good.reshape(-1, n).all(1)
                    yield n, some[rows[good]], item[entry[good]]


def is_in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Flags of the values among the known ones (sorted)."""
    if not len(known) or not len(values):
        return np.zeros(len(values), dtype=bool)
    table = np.zeros(1 << 20, dtype=bool)
    table[(known >> _U(44)).astype(np.int64)] = True
    out = table[(values >> _U(44)).astype(np.int64)]
    at = np.flatnonzero(out)
    out[at] = known[np.minimum(np.searchsorted(known, values[at]), len(known) - 1)] == values[at]
    return out


def extended(w: Words, hit: np.ndarray, window: int, k: int) -> np.ndarray:
    """The starts of all windows inside one text that hold one of the hit k-grams."""
    if not len(hit):
        return np.zeros(0, dtype=np.int64)
    near = np.unique((hit[:, None] - np.arange(window - k + 1)).ravel())
    near = near[(near >= 0) & (near + window <= len(w.hashes))]
    return near[gram_places(w.first, window, len(w.hashes))[near]]


def _spans(first: np.ndarray, hit: np.ndarray) -> pa.Array:
    """Per text the runs of hit words, counted from its first."""
    total = len(hit)
    fresh = np.zeros(total + 1, dtype=bool)  # where a text begins, runs end
    fresh[first] = True
    before = np.concatenate([[False], hit])[:-1]
    after = np.concatenate([hit, [False]])[1:]
    head = np.flatnonzero(hit & (~before | fresh[:total]))
    past = np.flatnonzero(hit & (~after | fresh[1:])) + 1
    of = np.searchsorted(first, head, "right") - 1
    cells = pa.StructArray.from_arrays([pa.array((head - first[of]).astype(np.int32)), pa.array((past - first[of]).astype(np.int32))], ["first", "past"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(head, first).astype(np.int32)), cells)


def _reports(w: Words, bench: Benchmark) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Per text: count of words, items, spans of hit words."""
    edge, texts, found = np.zeros(len(w.hashes) + 1, dtype=np.int64), len(w.first) - 1, []
    for n, at, item in bench.places(w):
        starts = np.unique(at)
        edge[starts] += 1
        np.subtract.at(edge, starts + n, 1)
        found.append(np.unique((np.searchsorted(w.first, at, "right") - 1) << 32 | item))
    names: list[set[str]] = [set() for _ in range(texts)]
    for x in np.unique(np.concatenate(found)).tolist() if found else []:
        if (name := bench.names[x & 0xFFFFFFFF]) is not None:
            names[x >> 32].add(name)
    return pa.array(np.diff(w.first)), pa.array([sorted(x) for x in names], pa.list_(pa.string())), _spans(w.first, np.cumsum(edge)[:-1] > 0)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, k: int = K, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of docs: id_col, n_words, n_hit, items (ids as strings, sorted), spans of hit words.

    Words are [0-9a-z] and characters beyond ASCII after lower-casing A-Z; null
    and empty texts have none and are hit by nothing. Repeated rows are judged
    alike. An item without words has no window; one with a null id marks words
    but is not listed. An empty benchmark marks nothing. Rows that share an id
    are judged each by its own text. Other columns are ignored.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
    src = bounded(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    kind = docs.schema[id_col].dataType.simpleString()
    if _size(items) <= broadcast_bytes:
        found = _by_broadcast(src, items, kind, window, k)
    else:
        found = _by_shuffle(src.withColumn("digest", _digest("text")), items, kind, window, k)
    hit = F.aggregate("spans", F.lit(0), lambda n, s: n + s["past"] - s["first"]).cast("long")
    return found.select(F.col("id").alias(id_col), "n_words", hit.alias("n_hit"), "items", "spans")


def _size(items: DataFrame) -> int:
    """Bytes of the benchmark's names and texts."""
    each = F.coalesce(F.octet_length("text"), F.lit(0)) + F.coalesce(F.octet_length("item"), F.lit(0)) + 8
    return items.agg(F.coalesce(F.sum(each), F.lit(0))).first()[0]


def _digest(text: str) -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def uncontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, k: int = K, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of docs, all columns, of which no word is in a window of the benchmark. Each row is judged by its own text, whatever its id."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
    docs = bounded(docs)
    if _size(items) > broadcast_bytes:
        texts = docs.select(F.lit(None).cast("string").alias("id"), F.col(text_col).alias("text")).withColumn("digest", _digest("text")).dropDuplicates(["digest"])
        gone = _by_shuffle(texts, items, "string", window, k).where(F.size("spans") > 0).select("digest")
        return docs.join(gone, _digest(text_col) == gone["digest"], "left_anti").select(docs.columns)
    known = _shared(docs, items, window, k)
    column = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = flat(b.column(column))
            for i, j in runs(offs):
                w = Words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                clean = np.ones(j - i, dtype=bool)
                for _, at, _ in known.value.places(w):
                    clean[np.searchsorted(w.first, at, "right") - 1] = False
                yield b.slice(i, j - i).filter(pa.array(clean))

    return docs.mapInArrow(keep, docs.schema)


def _shared(docs: DataFrame, items: DataFrame, window: int, k: int) -> Broadcast:
    return docs.sparkSession.sparkContext.broadcast(Benchmark([(r["item"], r["text"]) for r in items.toLocalIterator()], window, k))


def _by_broadcast(src: DataFrame, items: DataFrame, kind: str, window: int, k: int) -> DataFrame:
    known = _shared(src, items, window, k)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = flat(b.column(1))
            for i, j in runs(offs):
                w = Words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *_reports(w, known.value)], ["id", "n_words", "items", "spans"])

    return src.mapInArrow(scan, f"id {kind}, n_words long, items array<string>, spans {SPANS}")


def _marks(items: DataFrame, hashes: Callable[[Words], np.ndarray]) -> np.ndarray:
    """A table of 2^_MARKS bits with those set that the benchmark's hashes lead to."""

    def mark(own: np.ndarray, b: pa.RecordBatch) -> None:
        data, offs = flat(b.column(0))
        for i, j in runs(offs):
            at = _slot(hashes(Words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])))
            np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))

    return merged(items.select("text"), 1 << (_MARKS - 3), np.uint8, mark, np.bitwise_or)


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _U(64 - _MARKS)).astype(np.int64)


def _by_shuffle(src: DataFrame, items: DataFrame, kind: str, window: int, k: int) -> DataFrame:
    """src: id, text, digest. Texts are told apart by their digest, so that equal texts are searched once."""
    lengths = items.mapInArrow(_lengths, "n int").where(f"n > 0 and n < {window}").distinct()
    short = sorted(r[0] for r in lengths.collect())  # below window at most

    def whole(w: Words) -> np.ndarray:
        flags, grams = w.winnow(window, k)
        return grams[flags]

    def brief(w: Words) -> np.ndarray:
        """Hashes of the items below a window, each under its length."""
        count = np.diff(w.first)
        at = [w.first[:-1][count == n] for n in short]
        return np.concatenate([np.zeros(0, _U), *(gram_hashes(w.hashes, n)[x] for n, x in zip(short, at, strict=True) if len(x))])

    spark = src.sparkSession
    long_marks = spark.sparkContext.broadcast(_marks(items, whole))
    short_marks = spark.sparkContext.broadcast(_marks(items, brief) if short else None)
    may = lambda table, h: (table[_slot(h) >> 3] >> (_slot(h) & 7) & 1).astype(bool)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = flat(b.column(1))
            for i, j in runs(offs):
                w = Words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                flags, grams = w.winnow(window, k)
                at = np.flatnonzero(flags)
                at = at[may(long_marks.value, grams[at])]
                of = np.searchsorted(w.first, at, "right") - 1
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).take(pa.array(of)), pa.array((at - w.first[of]).astype(np.int32)), pa.array(grams[at].view(np.int64))], ["key", "at", "h"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct windows of each text and where they are: around the hits in column 2 (null: an item, everywhere), and those of the short lengths that items may have."""
        for b in batches:
            for key, text, hits in zip(*(c.to_pylist() for c in b.columns), strict=True):
                w = Words(*flat(pa.array([text], pa.string())))
                n, places = len(w.hashes), {}
                if hits is None:
                    places[min(n, window)] = np.arange(max(0, n - window + 1)) if n >= window else np.zeros(min(n, 1), np.int64)
                else:
                    for m in short:
                        own = gram_hashes(w.hashes, m)
                        places[m] = np.flatnonzero(may(short_marks.value, own)) if len(own) else np.zeros(0, np.int64)
                    places[window] = extended(w, np.array(sorted(hits), dtype=np.int64), window, k)
                for m, at in places.items():
                    met: dict[bytes, list[int]] = {}
                    for p in at.tolist():
                        met.setdefault(w.text(p, m), []).append(p)
                    if met:
                        yield pa.RecordBatch.from_arrays([pa.array([key] * len(met), pa.string()), pa.array(list(met.values()), pa.list_(pa.int32())), pa.array(np.full(len(met), m, np.int32)), pa.array(list(met), pa.binary())], ["key", "at", "n", "w"])

    texts = src.select("digest", "text").dropDuplicates(["digest"])
    marks = items.select(F.col("item").alias("digest"), "text").mapInArrow(keep, "key string, at int, h long").select("h").distinct()
    hits = texts.mapInArrow(keep, "key string, at int, h long").join(marks, "h", "left_semi").groupBy("key").agg(F.collect_set("at").alias("hits"))
    form = "key string, at array<int>, n int, w binary"
    asked = texts.join(hits, texts["digest"] == hits["key"], "left" if short else "inner").select("digest", "text", F.coalesce("hits", F.array().cast("array<int>")).alias("hits"))
    windows = items.withColumn("hits", F.lit(None).cast("array<int>")).select("item", "text", "hits").mapInArrow(spread, form).select(F.col("key").alias("item"), F.col("n").alias("m"), "w").distinct()
    found = asked.mapInArrow(spread, form).join(windows, "w").where("n = m")
    places = F.transform("at", lambda p: F.struct(p.alias("first"), (p + F.col("n")).alias("past")))
    per = found.groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"), F.flatten(F.collect_set(places)).alias("places"))

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = flat(b.column(1))
            hits = b.column(3).to_pylist()
            for i, j in runs(offs):
                first = words(LOWER[data[offs[i] : offs[j]]], offs[i : j + 1] - offs[i], NOT_ALNUM)[2]
                edge = np.zeros(first[-1] + 1, dtype=np.int64)
                for t in range(i, j):
                    for p in hits[t] or []:
                        edge[first[t - i] + p["first"]] += 1
                        edge[first[t - i] + p["past"]] -= 1
                cols = [b.column(0).slice(i, j - i), pa.array(np.diff(first)), b.column(2).slice(i, j - i), _spans(first, np.cumsum(edge)[:-1] > 0), b.column(4).slice(i, j - i)]
                yield pa.RecordBatch.from_arrays(cols, ["id", "n_words", "items", "spans", "digest"])

    joined = src.join(per, src["digest"] == per["key"], "left").select("id", "text", F.coalesce("items", F.array().cast("array<string>")).alias("items"), "places", "digest")
    return joined.mapInArrow(report, f"id {kind}, n_words long, items array<string>, spans {SPANS}, digest string")


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offs = flat(b.column(1))
        n = [x for i, j in runs(offs) for x in np.diff(words(LOWER[data[offs[i] : offs[j]]], offs[i : j + 1] - offs[i], NOT_ALNUM)[2]).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(n, pa.int32())], ["n"])
