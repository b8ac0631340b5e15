"""Byte-level BPE encoding and decoding by overlapping chunks.

Short texts are encoded where they are. A long one is cut into chunks that
overlap; each chunk is pre-tokenised on its own, wherever it happens to start.
The pattern has no memory, so from the first place at which two neighbours both
start a match they agree for good. There the chunks are stitched, and each
encodes the pieces up to the next seam. Neighbours that share no such place in
their overlap (one match is longer than it) send their text on and are encoded
as one. Decoding concatenates the ids' bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._pieces import Encoder, Spelling, piece_starts, unsure
from ._store import bounded
from ._text import flat, runs

CHUNK, OVERLAP = 1 << 16, 1 << 12


@lru_cache(maxsize=2)
def _codec(path: str, pattern: str) -> Encoder:
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return Encoder(lambda ps: [enc._encode_single_piece(p) for p in ps], enc.encode_ordinary, _strings(ranks))


def _strings(ranks: dict[bytes, int]) -> list[bytes]:
    out = [b""] * (max(ranks.values()) + 1)
    for k, v in ranks.items():
        out[v] = k
    return out


def default_vocabulary() -> tuple[str, str]:
    """The rank file and its pattern, as installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _lists(ids: np.ndarray, upto: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """id_col and ids (array of int) of every row; null and empty texts have none.

    Special tokens are ordinary text. Repeated rows stay, null ids too; an
    empty table gives no rows; other columns are ignored.
    """
    path, pat = (vocabulary, pattern) if vocabulary and pattern else default_vocabulary()
    kind = docs.schema[id_col].dataType.simpleString()
    src = bounded(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    size = F.coalesce(F.octet_length("text"), F.lit(0))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pat)
        for b in batches:
            data, offs = flat(b.column(1))
            for i, j in runs(offs):
                ids, upto = codec.texts(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), _lists(ids, upto)], ["id", "ids"])

    near = src.where(size <= chunk).mapInArrow(short, f"id {kind}, ids array<int>")
    far = _long(src.where(size > chunk), kind, path, pat, chunk, overlap)
    return near.union(far).select(F.col("id").alias(id_col), "ids")


def _long(src: DataFrame, kind: str, path: str, pat: str, chunk: int, overlap: int) -> DataFrame:
    parts = f"row long, id {kind}, n int, part int, base long, text binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = flat(b.column(2))
            for t in range(b.num_rows):
                raw = data[offs[t] : offs[t + 1]]
                n = -(-len(raw) // chunk)
                if unsure(raw):  # the whole text to the tokenizer
                    n = 1
                for k in range(n):
                    lo, hi = (max(0, k * chunk - overlap), min(len(raw), (k + 1) * chunk + overlap)) if n > 1 else (0, len(raw))
                    while lo and raw[lo] & 0xC0 == 0x80:
                        lo -= 1
                    while hi < len(raw) and raw[hi] & 0xC0 == 0x80:
                        hi += 1
                    cols = [b.column(0).slice(t, 1), b.column(1).slice(t, 1), pa.array([n], pa.int32()), pa.array([k], pa.int32()), pa.array([lo], pa.int64()), pa.array([raw[lo:hi].tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, ["row", "id", "n", "part", "base", "text"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds where matches start in the overlap with the chunk before and the one after."""
        for b in batches:
            head, tail = [], []
            for n, k, base, text in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                raw = np.frombuffer(text, np.uint8)
                at = piece_starts(raw, np.array([0, len(raw)])) + base if n > 1 else np.zeros(0, np.int64)
                end = base + len(raw)
                head.append(at[(at >= k * chunk) & (at < k * chunk + overlap)] if k else at[:0])
                tail.append(at[(at >= (k + 1) * chunk) & (at < min(end, (k + 1) * chunk + overlap))] if k + 1 < n else at[:0])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(head, pa.list_(pa.int64())), pa.array(tail, pa.list_(pa.int64()))], [*b.schema.names, "head", "tail"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ids from this chunk's seam to the next, or the text in between if the document has a missing seam."""
        codec = _codec(path, pat)
        for b in batches:
            for t in range(b.num_rows):
                row, n, k, base, text, lo, hi, torn = (b.column(i)[t].as_py() for i in (0, 2, 3, 4, 5, 6, 7, 8))
                raw, ids, rest = np.frombuffer(text, np.uint8), np.zeros(0, np.int32), b""
                if torn:
                    lo, hi = k * chunk - base, (k + 1) * chunk - base if k + 1 < n else len(raw)
                    rest = raw[lo:hi].tobytes()
                elif n == 1:
                    ids = codec.texts(raw, np.array([0, len(raw)]))[0]
                else:
                    at = piece_starts(raw, np.array([0, len(raw)]))
                    lo, hi = lo - base if k else 0, hi - base if k + 1 < n else len(raw)
                    some = at[(at >= lo) & (at < hi)]
                    ids = codec.pieces(raw, some, np.append(some[1:], hi), np.array([lo, hi]))[0]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(t, 1), b.column(1).slice(t, 1), b.column(3).slice(t, 1), pa.array([ids], pa.list_(pa.int32())), pa.array([rest], pa.binary())], ["row", "id", "part", "ids", "rest"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pat)
        for b in batches:
            out = []
            for parts in b.column(1).to_pylist():
                rest = b"".join(p["rest"] for p in parts)
                out.append(codec.texts(np.frombuffer(rest, np.uint8), np.array([0, len(rest)]))[0] if rest else np.concatenate([np.array(p["ids"], np.int32) for p in parts]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int32()))], ["id", "ids"])

    width = int(src.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = src.select(F.monotonically_increasing_id().alias("row"), "id", "text").mapInArrow(cut, parts).repartition(width, "row", "part")
    marked = chunks.mapInArrow(mark, f"{parts}, head array<long>, tail array<long>")
    order = Window.partitionBy("row").orderBy("part")
    both = marked.withColumn("lo", F.array_min(F.array_intersect("head", F.lag("tail").over(order))))
    both = both.withColumn("hi", F.lead("lo").over(order)).withColumn("torn", F.max((F.col("part") > 0) & F.col("lo").isNull()).over(Window.partitionBy("row")))
    done = both.select("row", "id", "n", "part", "base", "text", "lo", "hi", "torn").repartition(width, "row", "part").mapInArrow(finish, f"row long, id {kind}, part int, ids array<int>, rest binary")
    whole = done.groupBy("row").agg(F.first("id").alias("id"), F.sort_array(F.collect_list(F.struct("part", "ids", "rest"))).alias("parts"))
    return whole.select("id", "parts").mapInArrow(gather, f"id {kind}, ids array<int>")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """id_col and bytes of every row; a null or empty list is no bytes."""
    path = vocabulary or default_vocabulary()[0]
    kind = encoded.schema[id_col].dataType.simpleString()

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _spelling(path)
        for b in batches:
            out = [table.of(ids).tobytes() for ids in _per_row(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["id", "bytes"])

    return bounded(encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))).mapInArrow(spell, f"id {kind}, bytes binary").select(F.col("id").alias(id_col), "bytes")


@lru_cache(maxsize=2)
def _spelling(path: str) -> Spelling:
    with open(path, "rb") as f:
        return Spelling(_strings({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}))


def _per_row(column: pa.Array) -> Iterator[np.ndarray]:
    values, offs = column.values.to_numpy(), column.offsets.to_numpy()
    good = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield values[offs[i] : offs[i + 1]] if good[i] else values[:0]


def _digest(table: Spelling, decimal: Spelling, lists: Iterator[np.ndarray]) -> list[pa.Array]:
    n, ids, text = [], [], []
    for x in lists:
        n.append(len(x))
        ids.append(hashlib.sha256(decimal.of(x)[:-1].tobytes()).hexdigest())
        text.append(hashlib.sha256(table.of(x).tobytes()).hexdigest())
    return [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())]


@lru_cache(maxsize=2)
def _decimal(size: int) -> Spelling:
    return Spelling([b"%d " % i for i in range(size)])


def _digest_form(id_col: str, kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(id_col, kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def digests(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """id_col, n_tokens, ids_sha256 (of the decimal ids, one space between) and decoded_sha256; a null list is an empty one."""
    path = vocabulary or default_vocabulary()[0]
    form = _digest_form(id_col, encoded.schema[id_col].dataType)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _spelling(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *_digest(table, _decimal(len(table.size)), _per_row(b.column(1)))], form.names)

    return bounded(encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))).mapInArrow(digest, form)


def encoded_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """digests(encode(docs)), where short texts are encoded, decoded and digested in one pass."""
    path, pat = (vocabulary, pattern) if vocabulary and pattern else default_vocabulary()
    form = _digest_form(id_col, docs.schema[id_col].dataType)
    src = bounded(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    size = F.coalesce(F.octet_length("text"), F.lit(0))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, table = _codec(path, pat), _spelling(path)
        for b in batches:
            data, offs = flat(b.column(1))
            for i, j in runs(offs):
                ids, upto = codec.texts(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                lists = (ids[p:q] for p, q in zip(upto[:-1], upto[1:], strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *_digest(table, _decimal(len(table.size)), lists)], form.names)

    near = src.where(size <= chunk).mapInArrow(short, form)
    far = _long(src.where(size > chunk), docs.schema[id_col].dataType.simpleString(), path, pat, chunk, overlap)
    return near.union(digests(far, "id", "ids", path).withColumnRenamed("id", id_col))
