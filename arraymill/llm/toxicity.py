"""Toxicity by multiple-instance learning.

Only documents have labels. A document's probability is the noisy-or of its
sentences' probabilities, and a sentence's is a logistic function of its words
and of the runs of five bytes inside them (so that a stem counts with endings
not met before). The weights are learned from document labels, and what they
say of single sentences shows where the offence is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import bounded
from ._text import LOWER, flat, mix, runs, separators, span_hashes, words

_U = np.uint64
#: Words are runs of ASCII letters and of characters beyond ASCII; sentences end at these bytes.
_WORDS = separators((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True
BITS, MAX_ROWS, MAX_BYTES, GRAM = 20, 6000, 32 << 20, 5
#: Words and runs enter if they are in so many training rows at least, and their share of positive rows is further off than
#: chance takes the furthest of as many (the square root of twice the logarithm of their count, in deviations).
LEAST_DOCS = 3


def _buckets(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's bucket followed by those of its runs, and where each word's buckets start (one more at the end)."""
    count = np.maximum(ends - starts - GRAM + 1, 0)
    first = np.concatenate([[0], np.cumsum(count + 1)])
    out = np.empty(int(first[-1]), dtype=np.int64)
    own = np.zeros(len(out), dtype=bool)
    own[first[:-1]] = True
    out[own] = (span_hashes(low, starts, ends) >> _U(64 - BITS)).astype(np.int64)
    at = np.arange(int(count.sum())) + np.repeat(starts - (np.cumsum(count) - count), count)
    key = np.zeros(len(at), dtype=_U)
    for k in range(GRAM):
        key = (key << _U(8)) | low[at + k]
    out[~own] = (mix(key + _U(1)) >> _U(64 - BITS)).astype(np.int64)
    return out, first


def _sentences(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words; where each sentence's buckets start (one more at the end); where its words do; each text's first sentence (likewise); the words' starts and ends."""
    low = LOWER[raw]
    starts, ends, first = words(low, offs, _WORDS)
    buckets, at = _buckets(low, starts, ends)
    stops = np.concatenate([[0], np.cumsum(_ENDS[raw])])[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = stops[1:] != stops[:-1]
    new[first[:-1][first[:-1] < len(starts)]] = True
    heads = np.flatnonzero(new)
    cuts = np.append(heads, len(starts))
    return buckets, at[cuts], cuts, np.searchsorted(heads, first), starts, ends


def _sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The sum of values[cuts[i]:cuts[i + 1]] for every i."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[cuts[1:]] - total[cuts[:-1]]


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


@dataclass
class Model:
    """Weights of 2^BITS buckets of words, and a sentence's bias."""

    weights: np.ndarray
    bias: float

    def judge(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Scores of texts; then scores of sentences with the texts' first sentences, the sentences' first words, and the words' bytes."""
        buckets, spans, cuts, first, starts, ends = _sentences(raw, offs)
        z = np.clip(self.bias + _sums(self.weights[buckets], spans), -60, 60)
        evidence = _sums(_softplus(z), first)
        evidence[np.diff(first) == 0] = _softplus(np.array(self.bias))  # a text without words is one empty sentence
        return -np.expm1(-evidence), 1 / (1 + np.exp(-z)), first, cuts, starts, ends


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, steps: int = 300, rate: float = 0.1, decay: float = 1e-5) -> Model:
    """A model of the labelled documents, from about max_rows of them with about max_bytes of text, chosen by a hash of their id.

    Labels join by id; rows without a label or with a null id are not used,
    repeated rows count as often as they occur. The driver gets hashed words of
    the chosen rows, some ten bytes a byte of text, and no texts. No row at all
    (an empty table, no labels) gives a model that scores everything 0.
    """
    lab = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    src = bounded(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    pick = lambda share: lab if share >= 1 else lab.where(F.pmod(F.xxhash64("id"), F.lit(1 << 32)) < int(share * (1 << 32)))
    share = min(1.0, max_rows / max(lab.count(), 1))
    size = src.select("id", F.octet_length("text").alias("size")).join(pick(share), "id").agg(F.sum("size")).first()[0] or 0
    lab = pick(share * min(1.0, max_bytes / max(size, 1)))
    src = src.join(lab, "id").select("text", "y")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = flat(b.column(0))
            for i, j in runs(offs):
                buckets, cuts, _, first, _, _ = _sentences(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                rows = [(buckets[cuts[first[t]] : cuts[first[t + 1]]].astype("<i4").tobytes(), np.diff(cuts[first[t] : first[t + 1] + 1]).astype("<i4").tobytes()) for t in range(j - i)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()), b.column(1).slice(i, j - i)], ["w", "s", "y"])

    rows = src.mapInArrow(features, "w binary, s binary, y int").toLocalIterator()
    w, s, y = [], [], []
    for r in rows:
        w.append(np.frombuffer(r["w"], "<i4"))
        s.append(np.frombuffer(r["s"], "<i4"))
        y.append(r["y"])
    return _train(w, s, np.array(y, dtype=np.float64), steps, rate, decay)


def _train(w: list[np.ndarray], s: list[np.ndarray], y: np.ndarray, steps: int, rate: float, decay: float) -> Model:
    weights = np.zeros(1 << BITS)
    if not len(y) or not y.any():
        return Model(weights, -60.0)
    df, hits, mean = np.zeros(1 << BITS), np.zeros(1 << BITS), float(y.mean())
    for x, label in zip(w, y, strict=True):
        some = np.unique(x)
        df[some] += 1
        hits[some] += label
    off = np.abs(hits - df * mean) / np.sqrt(np.maximum(df * mean * (1 - mean), 1e-9))
    often = df >= LEAST_DOCS
    used = np.flatnonzero(often & (off >= np.sqrt(2 * np.log(max(2, often.sum())))))
    number = np.full(1 << BITS, len(used), dtype=np.int64)  # the last weight stays zero
    number[used] = np.arange(len(used))
    sizes = np.concatenate([x if len(x) else np.zeros(1, np.int32) for x in s]).astype(np.int64)
    first = np.concatenate([[0], np.cumsum([max(1, len(x)) for x in s])])
    word, of = number[np.concatenate(w)], np.repeat(np.arange(len(sizes)), sizes)
    kept = word < len(used)
    word, of = word[kept], of[kept]
    theta, bias = np.zeros(len(used)), float(np.log(max(y.mean(), 1e-6) * len(y) / len(sizes)))
    cuts = np.searchsorted(of, np.arange(len(sizes) + 1))
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    doc = np.repeat(np.arange(len(y)), np.diff(first))
    for t in range(1, steps + 1):
        z = np.clip(bias + _sums(theta[word], cuts), -60, 60)
        evidence = np.maximum(_sums(_softplus(z), first), 1e-12)
        slope = (1 - y) - y * np.exp(-evidence) / -np.expm1(-evidence)
        dz = slope[doc] / (1 + np.exp(-z)) / len(y)
        g, gb = np.bincount(word, dz[of], minlength=len(used)) + decay * theta, float(dz.sum())
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        up, down = 1 - 0.9**t, 1 - 0.99**t
        theta -= rate * (m / up) / (np.sqrt(v / down) + 1e-7)
        bias -= rate * (mb / up) / (np.sqrt(vb / down) + 1e-7)
    weights[used] = theta
    return Model(weights, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", locate: float = 0.5) -> DataFrame:
    """One row per row of docs: id_col, score, offending (sentences that score at least locate, in order).

    Null and texts without words count as one empty sentence. Only the text
    tells the score: repeated rows score alike, null ids stay, an empty table
    gives no rows, other columns are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size
    kind = docs.schema[id_col].dataType.simpleString()
    place = pa.struct([("sentence", pa.int32()), ("text", pa.string()), ("score", pa.float64())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = flat(b.column(1))
            for i, j in runs(offs):
                raw = data[offs[i] : offs[j]]
                total, each, first, cuts, starts, ends = shared.value.judge(raw, offs[i : j + 1] - offs[i])
                found: list[list[dict]] = [[] for _ in range(j - i)]
                for s in np.flatnonzero(each >= locate):
                    t = int(np.searchsorted(first, s, "right")) - 1
                    text = raw[starts[cuts[s]] : ends[cuts[s + 1] - 1]].tobytes().decode()
                    found[t].append({"sentence": int(s - first[t]), "text": text, "score": float(each[s])})
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(total), pa.array(found, pa.list_(place))], ["id", "score", "offending"])

    out = bounded(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(judge, f"id {kind}, score double, offending array<struct<sentence:int,text:string,score:double>>")
    return out.select(F.col("id").alias(id_col), "score", "offending")


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose text scores below cut."""
    docs = bounded(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = flat(b.column(at))
            for i, j in runs(offs):
                total = shared.value.judge(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])[0]
                yield b.slice(i, j - i).filter(pa.array(total < cut))

    return docs.mapInArrow(keep, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
