"""Vectorised text kernels shared by the corpus operators.

A batch of texts is handled as one byte array plus offsets, so that word
splitting and hashing run in numpy over whole batches instead of in Python
over single words. Work is cut into runs of texts of bounded size; one text
longer than a run makes a run of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time.
RUN_BYTES = 1 << 18

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1 if (0x9E3779B97F4A7C15 % 4) == 3 else 0xD1342543DE82EF97
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=_U)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base & _MASK, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(0, dtype=_U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 12)
            self.up, self.down = _powers(self.base, size), _powers(self.inverse, size)
        return self.up[:n], self.down[:n]


_BYTE_POWERS = _Powers(_BASE)
_WORD_POWERS = _Powers(0xA0761D6478BD642F)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every bit over the whole word."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


#: A random 64-bit value for each byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its len + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def runs(offs: np.ndarray, size: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold at most ``size`` bytes, or one longer text."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = j


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags that are true for the bytes in the ranges."""
    table = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


#: Words are [^\x20\x09-\x0D]+
BLANKS = separators((0x20, 0x20), (0x09, 0x0D))
#: Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing of A-Z
NOT_ALNUM = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def words(data: np.ndarray, offs: np.ndarray, seps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the number of its first word (one more at the end)."""
    n = len(data)
    inside = np.empty(n + 1, dtype=bool)
    np.logical_not(seps[data], out=inside[:n])
    inside[n] = False
    cut = np.zeros(n + 1, dtype=bool)
    cut[offs] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:]
    last = inside[:-1] & (~inside[1:] | cut[1:])
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are ascending and do not overlap."""
    out, i = np.empty(len(starts), dtype=_U), 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + RUN_BYTES, "right")))
        hi = int(ends[j - 1])
        up, down = _BYTE_POWERS.get(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, dtype=_U)
        np.cumsum(values[data[lo:hi]] * up[:-1], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(_U))
        i = j
    return out


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, as if all words were one text."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=_U)
    up, down = _WORD_POWERS.get(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, dtype=_U)
    np.cumsum(hashes * up[:-1], out=sums[1:])
    return mix((sums[n:] - sums[:m]) * down[:m] + _U(n))


def gram_places(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """Flags for the words that start a run of n words inside their own text; first: as from words()."""
    ok = np.zeros(max(0, total - n + 1), dtype=bool)
    if len(ok):
        edge = np.zeros(total + 1, dtype=np.int32)
        np.add.at(edge, np.minimum(first[:-1], total), 1)
        length = np.diff(first)
        left = np.repeat(first[1:], length) - np.arange(total)
        ok[:] = left[: len(ok)] >= n
    return ok


def covered(flags: np.ndarray, n: int, total: int) -> np.ndarray:
    """Flags for the words inside any of the flagged runs of n words."""
    edge = np.zeros(total + 1, dtype=np.int32)
    at = np.flatnonzero(flags)
    edge[at] += 1
    np.subtract.at(edge, at + n, 1)
    return np.cumsum(edge)[:total] > 0


def clear_of(names: list[str], name: str) -> str:
    """A column name that is not in use yet."""
    while name in names:
        name = f"_{name}"
    return name
