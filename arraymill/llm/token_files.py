"""Token ids as files: blocks of concatenated ids with Elias-Fano document ends.

A file set is a folder with ``blocks`` and ``index``. A block holds the ids of
consecutive documents as little-endian unsigned integers (two bytes if the
vocabulary allows, else four), the documents' ends in the block and their
ids, both as Elias-Fano lists. The index has the place of each block's first
id among all ids. Blocks are written by Spark's committer, so a lost executor
leaves no half a file, and any store that Spark can write will do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._elias_fano import View, pack
from ._pieces import Encoder
from ._store import bounded
from ._text import flat, runs

BLOCK_IDS = 1 << 20
_BLOCK = "part int, block int, n_docs int, n_ids long, width int, nulls int, least long, docs binary, ends binary, ids binary"


@lru_cache(maxsize=2)
def _codec(path: str) -> tuple[Encoder, int]:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(path)
    letters = _byte_letters()
    size = tk.get_vocab_size(with_added_tokens=True)
    names = [tk.id_to_token(i) or "" for i in range(size)]
    strings = [bytes(letters[c] for c in x) if all(c in letters for c in x) else b"" for x in names]

    def some(pieces: list[bytes]) -> list[list[int]]:
        """A few thousand at a time, as the library's results are large."""
        return [x.ids for i in range(0, len(pieces), 2048) for x in tk.encode_batch_fast([p.decode() for p in pieces[i : i + 2048]], add_special_tokens=False)]

    return Encoder(
        some,
        lambda t: tk.encode(t, add_special_tokens=False).ids,
        strings,
        [t.content.encode() for t in tk.get_added_tokens_decoder().values()],  # in a text they are themselves, as the library has it
    ), size


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes for themselves, others in order from 256 up."""
    out, spare = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[chr(b)] = b
        else:
            out[chr(spare)] = b
            spare += 1
    return out


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 0, block_ids: int = BLOCK_IDS) -> None:
    """Writes the ids of all texts, each followed by end_id, in ascending order of id_col.

    Null ids come first, rows that share an id in the order of their texts;
    null and empty texts are an end id alone. A document is never cut, so one
    of more than block_ids ids makes a longer block. An empty table writes a
    file set without blocks. Other columns are ignored.
    """
    name = tokenizer or default_tokenizer()
    src = bounded(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    src = src.repartitionByRange("id").sortWithinPartitions("id", "text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, size = _codec(name)
        width = 2 if size <= 1 << 16 else 4
        part, block = TaskContext.get().partitionId(), 0
        held: list[tuple[list[int | None], np.ndarray, np.ndarray]] = []
        total = 0

        def flush() -> pa.RecordBatch:
            names = [x for h in held for x in h[0]]
            known = np.array([x for x in names if x is not None], dtype=np.int64)
            least = int(known[0]) if len(known) else 0
            ends = np.cumsum(np.concatenate([h[1] for h in held]))
            ids = np.concatenate([h[2] for h in held]).astype(f"<u{width}")
            row = [part, block, len(names), len(ids), width, len(names) - len(known), least, pack(known - least), pack(ends), ids.tobytes()]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 3]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [x.split()[0] for x in _BLOCK.split(", ")])

        for b in batches:
            data, offs = flat(b.column(1))
            for i, j in runs(offs):
                ids, upto = codec.texts(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                count = np.diff(upto)
                full = np.insert(ids, upto[1:], end_id)
                held.append((b.column(0).slice(i, j - i).to_pylist(), count + 1, full))
                total += len(full)
                if total >= block_ids:
                    yield flush()
                    block, held, total = block + 1, [], 0
        if held:
            yield flush()

    src.mapInArrow(build, _BLOCK).write.option("parquet.block.size", 8 << 20).parquet(f"{path}/blocks")
    spark = docs.sparkSession
    sizes = spark.read.parquet(f"{path}/blocks").select("part", "block", "n_ids")
    parts = sorted(sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # one row per partition of the write
    start, starts = 0, []
    for part, n in parts:
        starts.append((part, start))
        start += n
    at = spark.createDataFrame(starts, "part int, first long")
    before = F.sum("n_ids").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    sizes.join(at, "part").select("part", "block", (F.col("first") + F.coalesce(before, F.lit(0))).alias("start")).write.parquet(f"{path}/index")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (with the end id) of every document in a file set."""
    blocks = spark.read.parquet(f"{path}/blocks").join(spark.read.parquet(f"{path}/index"), ["part", "block"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, nulls, least, width, docs, ends, ids in zip(*(b[c].to_pylist() for c in ("start", "nulls", "least", "width", "docs", "ends", "ids")), strict=True):
                upto = np.concatenate([[0], View(ends).all()])
                names = pa.array([*[None] * nulls, *(View(docs).all() + least).tolist()], pa.int64())
                values = np.frombuffer(ids, f"<u{width}").astype(np.int32)
                rows = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([names, pa.array(start + upto[:-1]), rows], ["doc_id", "start", "ids"])

    return bounded(blocks.select("start", "nulls", "least", "width", "docs", "ends", "ids")).mapInArrow(unpack, "doc_id long, start long, ids array<int>")


def document(spark: SparkSession, path: str, doc_id: int) -> list[int]:
    """The ids of one document, by select() in the one block that has it."""
    found = spark.read.parquet(f"{path}/blocks").where(F.col("least") <= doc_id).orderBy(F.desc("least"), F.desc("part"), F.desc("block")).limit(1).first()
    if found is not None:
        names, ends = View(found["docs"]), View(found["ends"])
        lo, hi = 0, len(names)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if names.select(mid) + found["least"] < doc_id else (lo, mid)
        if lo < len(names) and names.select(lo) + found["least"] == doc_id:
            i = lo + found["nulls"]
            a, b = ends.select(i - 1) if i else 0, ends.select(i)
            return np.frombuffer(found["ids"], f"<u{found['width']}")[a:b].tolist()
    raise KeyError(doc_id)


def checksums(documents: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, offs = b.column(2).values.to_numpy().astype("<u4").tobytes(), b.column(2).offsets.to_numpy()
            crc = [zlib.crc32(values[4 * x : 4 * y]) for x, y in zip(offs[:-1], offs[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(offs).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return documents.select("doc_id", "start", "ids").mapInArrow(sums, "doc_id long, start long, n_tokens long, ids_crc32 long")
