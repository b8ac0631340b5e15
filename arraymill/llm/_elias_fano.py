"""Elias-Fano lists: ascending integers in near-minimal space with direct access."""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<qqBi")
_STEP = 256


def pack(values: np.ndarray) -> bytes:
    """Ascending non-negative integers, repeats allowed, as bytes."""
    values = np.asarray(values, dtype=np.int64)
    n = len(values)
    top = int(values[-1]) if n else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    bits = ((values[:, None] >> np.arange(low)) & 1).astype(np.uint8).ravel()
    high = np.zeros((top >> low) + n + 1 if n else 0, dtype=np.uint8)
    ones = (values >> low) + np.arange(n)
    high[ones] = 1
    marks = ones[::_STEP].astype("<u4")  # where every 256th one is
    upper = np.packbits(high, bitorder="little").tobytes()
    lower = np.packbits(bits, bitorder="little").tobytes()
    return _HEAD.pack(n, top, low, len(lower)) + marks.tobytes() + lower + upper


class View:
    """Access to a packed list without unpacking it."""

    def __init__(self, raw: bytes) -> None:
        self.n, self.top, self.low, size = _HEAD.unpack_from(raw)
        at = _HEAD.size
        count = -(-self.n // _STEP)
        self._marks = np.frombuffer(raw, "<u4", count, at)
        self._lower = np.frombuffer(raw, np.uint8, size, at + 4 * count)
        self._upper = np.frombuffer(raw, np.uint8, -1, at + 4 * count + size)

    def __len__(self) -> int:
        return self.n

    def _high(self, i: int) -> int:
        """The place of the i-th one in the upper bits."""
        at, left = int(self._marks[i // _STEP]), i % _STEP
        byte = at // 8
        word = int(self._upper[byte]) >> (at % 8) << (at % 8)
        while (found := word.bit_count()) <= left:
            left -= found
            byte += 1
            word = int(self._upper[byte])
        for _ in range(left):
            word &= word - 1
        return 8 * byte + (word & -word).bit_length() - 1

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        bits = range(i * self.low, (i + 1) * self.low)
        return ((self._high(i) - i) << self.low) | sum((int(self._lower[b >> 3]) >> (b & 7) & 1) << k for k, b in enumerate(bits))

    def all(self) -> np.ndarray:
        """All values."""
        ones = np.flatnonzero(np.unpackbits(self._upper, bitorder="little"))[: self.n]
        bits = np.unpackbits(self._lower, bitorder="little", count=self.n * self.low).reshape(self.n, self.low).astype(np.int64)
        return ((ones - np.arange(self.n)) << self.low) | (bits << np.arange(self.low)).sum(1)
