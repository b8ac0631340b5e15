"""Groups of texts whose sets of shingles are linked by a Jaccard similarity of at least a share, none missed.

SimHash comes first: fingerprints of the sets are searched within 3 bits (see
simhash), each set with its smallest neighbour there is verified on the whole
sets, and linked sets fall together. Texts with the same set are one node from
the start.

At a similarity of 0.8 two fingerprints of 64 bits differ in some 10 bits, give
or take 3, and no cut into parts searches so wide a radius without meeting most
pairs. What the fingerprints miss is found by a join of prefixes. All shingles
have one order, about from rare to frequent; of two sets that are similar enough
the first common shingle is among the first n - ceil(share n) + 1 of either, and
leaves enough behind it. What meets there is verified on the whole sets.

Not all that meet are paired, as a group of g near copies would have g^2 pairs.
With its neighbour by fingerprint each set is compared with one of those that
were chosen for its shingles, the one it shares most with. Where sets of
different components still share shingles, this is repeated with sets chosen
anew, one comparison a set and round, while many pairs are left and some are
found. Then all pairs of sets that share a shingle and are still apart are
compared, so the components are those of all links: a set's other neighbours by
fingerprint are among them, as similar sets share a leading shingle.

That last join drops pairs by sketches before they become rows: bit b of a
sketch says whether the set has an odd number of shingles in bucket b, so two
sets differ in at least as many shingles as their sketches differ in bits. What
it drops is no link; of sets of over some 1000 shingles it drops few.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bits import merged
from ._store import dense, stage
from ._text import LOWER, flat, mix, runs
from .components import components
from .simhash import SEED, fingerprint, links, shingle_hashes

_U = np.uint64
#: Bits of the buckets of shingles whose counts give the order and of the marks of sets to verify; bytes of text at a
#: time. Small, as each Python worker holds them.
_BUCKETS, _MARKS, _RUN = 20, 23, 1 << 18
#: One in so many shingles shared with a centre makes a set worth comparing with it first.
_LIKELY = 20
#: Longs of a sketch; rounds of comparisons with chosen sets at most.
_SKETCH, _ROUNDS = 8, 2


def sets(raw: np.ndarray, at: np.ndarray, shingle: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, where each text's begin, and a key of each set."""
    hashes, first = shingle_hashes(LOWER[raw], at, shingle, seed)
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    hashes, of = hashes[new], of[new]
    first = np.searchsorted(of, np.arange(len(first)))
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(mix(hashes), dtype=_U)])
    return hashes, first, mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(_U))


def _over_sets(docs: DataFrame, shingle: int, form: str, emit: Callable) -> DataFrame:
    """emit(ids, hashes, first, keys) gives the columns of a batch for each run of texts of docs (id, text)."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in form.split(", ")]
        for b in batches:
            data, offs = flat(b.column(1))
            for i, j in runs(offs, _RUN):
                got = emit(b.column(0).slice(i, j - i), *sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], shingle))
                yield pa.RecordBatch.from_arrays(got, names)

    return docs.select("id", "text").mapInArrow(compute, form)


def _known(docs: DataFrame, shingle: int) -> Broadcast:
    """A byte for each bucket of shingles that grows with the bucket's count."""

    def count(own: np.ndarray, b: pa.RecordBatch) -> None:
        data, offs = flat(b.column(0))
        for i, j in runs(offs, _RUN):
            hashes = sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], shingle)[0]
            np.add.at(own, (hashes >> _U(64 - _BUCKETS)).astype(np.int64), 1)

    counts = merged(docs.select("text"), 1 << _BUCKETS, np.int32, count, np.add)
    return docs.sparkSession.sparkContext.broadcast((4 * np.log2(counts + 1.0)).astype(np.uint8))


def _prefixes(docs: DataFrame, shingle: int, share: tuple[int, int]) -> DataFrame:
    """token, key, n, rest: each different set's leading shingles, its size and what is left of it from there."""
    (top, low), known = share, _known(docs, shingle)

    def prefix(ids: pa.Array, hashes: np.ndarray, first: np.ndarray, keys: np.ndarray) -> list[pa.Array]:
        n = np.diff(first)
        of = np.repeat(np.arange(len(n)), n)
        order = np.argsort((of << 32) | known.value[(hashes >> _U(64 - _BUCKETS)).astype(np.int64)], kind="stable")
        left = np.repeat(first[1:], n) - np.arange(len(hashes))  # of its set, itself included
        on = left >= (top * n[of] + low - 1) // low
        return [pa.array(hashes[order][on].view(np.int64)), pa.array(keys[of[on]].view(np.int64)), pa.array(n[of[on]].astype(np.int32)), pa.array(left[on].astype(np.int32))]

    return _over_sets(docs, shingle, "token long, key long, n int, rest int", prefix).repartition("token").dropDuplicates(["token", "key"])


def _sketches(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each set _SKETCH longs of parities."""
    n, width = len(first) - 1, 64 * _SKETCH
    at = (mix(hashes) % _U(width)).astype(np.int64) + np.repeat(np.arange(n) * width, np.diff(first))
    odd = (np.bincount(at, minlength=n * width) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).reshape(n, _SKETCH)


def _whole(pairs: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """key, held: the whole set for the keys in u and v of pairs (staged), and for some others."""

    def mark(own: np.ndarray, b: pa.RecordBatch) -> None:
        for c in b.columns:
            at = (c.to_numpy().view(_U) >> _U(64 - _MARKS)).astype(np.int64)
            np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))

    marks = docs.sparkSession.sparkContext.broadcast(merged(pairs.select("u", "v"), 1 << (_MARKS - 3), np.uint8, mark, np.bitwise_or))

    def whole(ids: pa.Array, hashes: np.ndarray, first: np.ndarray, keys: np.ndarray) -> list[pa.Array]:
        at = (keys >> _U(64 - _MARKS)).astype(np.int64)
        on = np.flatnonzero(marks.value[at >> 3] >> (at & 7) & 1)
        n = np.diff(first)
        keep = np.zeros(len(n), dtype=bool)
        keep[on] = True
        offs = np.concatenate([[0], np.cumsum(n[on])]).astype(np.int32)
        held = np.ascontiguousarray(hashes[np.repeat(keep, n)]).view(np.uint8)
        packed = pa.Array.from_buffers(pa.binary(), len(on), [None, pa.py_buffer(offs * 8), pa.py_buffer(held)])
        return [pa.array(keys[on].view(np.int64)), packed]

    return _over_sets(docs, shingle, "key long, held binary", whole).dropDuplicates(["key"])


def _verified(pairs: DataFrame, docs: DataFrame, shingle: int, share: tuple[int, int]) -> DataFrame:
    """Those of the pairs u, v (staged; further columns of longs are passed on) whose whole sets are similar enough."""
    top, low = share
    names, full = pairs.columns, _whole(pairs, docs, shingle)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            on = []
            for x, y in zip(b.column(len(names)), b.column(len(names) + 1), strict=True):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                on.append(both * low >= top * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(b.columns[: len(names)], names).filter(pa.array(on, pa.bool_()))

    left = pairs.join(full.withColumnsRenamed({"key": "u", "held": "hu"}), "u")
    both = left.join(full.withColumnsRenamed({"key": "v", "held": "hv"}), "v").select(*names, "hu", "hv")
    return both.mapInArrow(verify, ", ".join(f"{x} long" for x in names))


def _beside(prints: DataFrame) -> DataFrame:
    """u, v: each set of prints (key, fp) with its smallest neighbour by fingerprint, u < v; sets of one fingerprint with the smallest of them."""
    heads = stage(prints.groupBy("fp").agg(F.min("key").alias("id")))
    same = prints.join(heads, "fp").where("key <> id").select(F.col("id").alias("u"), F.col("key").alias("v"))
    near = links(heads).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return near.groupBy("v").agg(F.min("u").alias("u")).select("u", "v").union(same)


def grouped(docs: DataFrame, prints: DataFrame, shingle: int = 5, share: tuple[int, int] = (4, 5)) -> DataFrame:
    """node, component: the component of each set's key (docs: id, text; prints: key, n, fp and the sketch s) that is linked to another; the smallest of a component may have no row."""
    top, low = share
    heads = _prefixes(docs, shingle, share)
    centre = heads.groupBy("token").agg(F.min_by(F.struct("key", "n", "rest"), F.struct(F.col("n") - F.col("rest"), F.xxhash64("key"))).alias("c"), F.min("key").alias("least"), F.max("key").alias("most"))
    met = dense(heads.join(centre, "token").where("least < most").select("token", "key", "n", "rest", F.col("c.key").alias("c"), F.col("c.n").alias("m")))  # shingles that two sets have
    beside = met.where("key <> c").groupBy("key", "c", "n", "m").agg(F.count("*").alias("both"))
    likely = beside.where((F.least("n", "m") * low >= F.greatest("n", "m") * top) & _likely())
    star = likely.groupBy("key").agg(F.max_by("c", F.struct("both", "c")).alias("c"))
    pairs = star.select(F.least("key", "c").alias("u"), F.greatest("key", "c").alias("v")).union(_beside(prints)).distinct()
    edges = dense(_verified(dense(_possible(pairs, prints, top, low)), docs, shingle, share))
    reached = components(edges)
    placed = _mixed(met.join(reached, met["key"] == reached["node"], "left").select("token", "key", "n", "rest", F.coalesce("component", "key").alias("c")))
    for k in range(_ROUNDS):
        if _few(placed):
            break
        found = dense(_verified(dense(_possible(_chosen(placed, top, low, k), prints, top, low)), docs, shingle, share))
        if found.isEmpty():
            break
        edges = edges.union(found.select("u", "v"))
        reached = components(found.select(F.col("a").alias("u"), F.col("b").alias("v")))
        placed = _mixed(placed.join(reached, placed["c"] == reached["node"], "left").select("token", "key", "n", "rest", F.coalesce("component", "c").alias("c")))
    pairs = dense(_apart(placed.join(prints.select("key", "s"), "key"), top, low))
    return components(edges.union(_verified(pairs, docs, shingle, share)))


def _likely() -> Column:
    """Whom to compare before all others; nothing hangs on it."""
    return F.col("both") * _LIKELY >= F.least("n", "m")


def _possible(pairs: DataFrame, prints: DataFrame, top: int, low: int) -> DataFrame:
    """Those of the pairs u, v whose sketches allow a link."""
    a, b = (prints.select(F.col("key").alias(x), F.col("n").alias(f"n_{x}"), F.col("s").alias(f"s_{x}")) for x in "uv")
    return pairs.join(a, "u").join(b, "v").where(_near(top, low, "n_u", "s_u", "n_v", "s_v")).select(pairs.columns)


def _mixed(placed: DataFrame) -> DataFrame:
    """The rows of placed (token, key, n, rest and the set's component c) of shingles that sets of different components have."""
    mixed = placed.groupBy("token").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least < most").select("token")
    return dense(placed.join(mixed, "token", "left_semi"))


def _few(placed: DataFrame) -> bool:
    """Whether pairs of sets of different components that share a shingle are at most four times the rows of placed."""
    counts = placed.groupBy("token", "c").agg(F.count("*").alias("n")).groupBy("token").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
    rows, apart = counts.agg(F.sum("n"), F.sum(F.col("n").cast("double") * F.col("n") - F.col("own")) / 2).first()
    return (apart or 0) <= 4 * (rows or 0)


def _chosen(placed: DataFrame, top: int, low: int, k: int) -> DataFrame:
    """u, v and their components a, b: each set with one of another component among those that are chosen in round k for its shingles; the one it shares most with."""
    centre = placed.groupBy("token").agg(F.min_by(F.struct("key", "n", "rest", "c"), (F.col("n") - F.col("rest") + 1) * (F.pmod(F.xxhash64("key", F.lit(k)), F.lit(1 << 20)) + 1)).alias("m"))
    met = placed.join(centre, "token").where((F.col("c") != F.col("m.c")) & _enough(top, low, "n", "rest", "m.n", "m.rest"))
    beside = met.groupBy("key", "c", "n", F.col("m.key").alias("v"), F.col("m.c").alias("b"), F.col("m.n").alias("m")).agg(F.count("*").alias("both"))
    best = beside.where(_likely()).groupBy("key").agg(F.max_by(F.struct("c", "v", "b"), F.struct("both", "v")).alias("m"))
    return best.select(F.col("key").alias("u"), F.col("m.v").alias("v"), F.col("m.c").alias("a"), F.col("m.b").alias("b"))


def _enough(top: int, low: int, n: str, rest: str, m: str, left: str) -> Column:
    """Whether sets of n and m shingles can be similar enough with no more than rest and left of them in common."""
    return F.least(rest, left).cast("long") * (top + low) >= (F.col(n).cast("long") + F.col(m)) * top


def _near(top: int, low: int, n: str, s: str, m: str, t: str) -> Column:
    """Whether sets of n and m shingles with sketches s and t can be similar enough."""
    apart = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{s}.s{k}").bitwiseXOR(F.col(f"{t}.s{k}"))) for k in range(_SKETCH)))
    return apart.cast("long") * (top + low) <= (F.col(n).cast("long") + F.col(m)) * (low - top)


def _apart(placed: DataFrame, top: int, low: int) -> DataFrame:
    """u, v: all pairs of sets of different components that share a shingle and may be similar enough."""
    sides = placed.groupBy("token", "c").agg(F.min("n").alias("n"), F.max("rest").alias("rest"), F.min("key").alias("key"), F.max("key").alias("last"), F.min("s").alias("s"))  # the most that a component's sets can have
    a, b = (sides.select("token", F.col("c").alias(x), F.col("n").alias(f"m_{x}"), F.col("rest").alias(f"left_{x}"), F.col("key").alias(f"one_{x}"), F.col("s").alias(f"s_{x}"), (F.col("key") == F.col("last")).alias(f"lone_{x}")) for x in "ab")
    lone = F.col("lone_a") & F.col("lone_b")  # one set of either has the shingle: these two, as they are compared here
    sides = a.join(b, "token").where((F.col("a") < F.col("b")) & _enough(top, low, "m_a", "left_a", "m_b", "left_b") & (~lone | _near(top, low, "m_a", "s_a", "m_b", "s_b")))
    pair = lambda x, y: (F.least(x, y).alias("u"), F.greatest(x, y).alias("v"))
    sides = stage(sides.select(*(F.when(~lone, F.col(x)).alias(x) for x in ("token", "a", "b", "m_b", "left_b")), *(F.when(lone, F.col(x)).alias(x) for x in ("one_a", "one_b"))).distinct())
    alone, sides = sides.where("one_a is not null").select(*pair("one_a", "one_b")), sides.where("one_a is null").drop("one_a", "one_b")
    own = lambda x: placed.select("token", F.col("c").alias(x), *(F.col(k).alias(f"{k}_{x}") for k in ("key", "n", "rest", "s")))
    left = sides.join(own("a"), ["token", "a"]).where(_enough(top, low, "n_a", "rest_a", "m_b", "left_b"))
    both = left.join(own("b"), ["token", "b"]).where(_enough(top, low, "n_a", "rest_a", "n_b", "rest_b") & _near(top, low, "n_a", "s_a", "n_b", "s_b"))
    return both.select(*pair("key_a", "key_b")).union(alone).distinct()


def copies(docs: DataFrame, id_col: str, text_col: str, shingle: int = 5, share: tuple[int, int] = (4, 5)) -> DataFrame:
    """id, tag (a hash of the text), lone, first: one row for each of docs.

    Rows are told apart by id and text, so rows that share an id are judged each
    by its own text, and rows without an id by theirs. first: no row of a lower
    id (null is above all), and none of the same id and a lower tag, can be
    reached by links. lone: neither an id nor words, so nothing to compare by.
    """
    row = F.struct(F.col(id_col).isNull().alias("unknown"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tag"))
    src = docs.select(row.alias("id"), F.col(text_col).alias("text"))
    parts = [f"s{k}" for k in range(_SKETCH)]
    form = ", ".join([f"id {src.schema['id'].dataType.simpleString()}", "key long", "n int", "fp long", *(f"{x} long" for x in parts)])

    def node(ids: pa.Array, hashes: np.ndarray, first: np.ndarray, keys: np.ndarray) -> list[pa.Array]:
        cols = (keys.view(np.int64), np.diff(first).astype(np.int32), fingerprint(hashes, first).view(np.int64), *np.ascontiguousarray(_sketches(hashes, first).T))
        return [ids, *(pa.array(x) for x in cols)]

    nodes = stage(_over_sets(src, shingle, form, node).select("id", "key", "n", "fp", F.struct(*parts).alias("s")))
    prints = stage(nodes.drop("id").dropDuplicates(["key"]))
    reached = grouped(src, prints, shingle, share)
    joined = stage(nodes.join(reached, nodes["key"] == reached["node"], "left").select("id", "n", F.coalesce("component", "key").alias("root")))
    judged = joined.join(joined.groupBy("root").agg(F.min("id").alias("least")), "root")
    return judged.select("id.id", "id.tag", (F.col("id.unknown") & (F.col("n") == 0)).alias("lone"), (F.col("id") == F.col("least")).alias("first"))
