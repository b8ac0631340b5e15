"""Vectorised pre-tokenising and encoding for byte-level BPE vocabularies.

The pattern of the rank files only looks at the class of each character
(letter, number, blank, other), so the places where it cuts are found in numpy
over whole batches. Pieces repeat a great deal: each is looked up by its hash
in a table that grows as pieces are met, and only new ones go to the tokenizer.
Whatever comes out is decoded and compared with the input, so that a clash of
hashes could not go unnoticed.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence
from functools import cache

import numpy as np
import regex

from ._text import span_hashes

OTHER, LETTER, NUMBER, BLANK, UNSURE = 0, 1, 2, 3, 4
_U = np.uint64


@cache
def classes() -> np.ndarray:
    """The class of every code point; UNSURE where versions of Unicode disagree, as the tokenizers' own version isn't known."""
    out = np.zeros(0x110000, dtype=np.uint8)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, rule in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\p{White_Space}+")):
        for m in regex.finditer(rule, everything):
            for i in range(m.start(), m.end()):
                out[ord(everything[i])] = kind
    older = {"L": LETTER, "N": NUMBER}
    for c in everything:
        kind = out[ord(c)]
        if kind != BLANK and older.get(unicodedata.category(c)[0], OTHER) != kind:
            out[ord(c)] = UNSURE
    return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places where characters start in UTF-8, and their code points."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    out = data[at].astype(np.int32)
    for size, lead, mask in ((2, 0xC0, 0x1F), (3, 0xE0, 0x0F), (4, 0xF0, 0x07)):
        some = np.flatnonzero((out >= lead) & (out < (0xE0, 0xF0, 0xF8)[size - 2]) & (out < 0x100)) if size == 2 else np.flatnonzero((data[at] >= lead) & (data[at] < (0xF0, 0xF8)[size - 3]))
        if len(some):
            cp = (data[at[some]] & mask).astype(np.int32)
            for k in range(1, size):
                cp = (cp << 6) | (data[at[some] + k] & 0x3F)
            out[some] = cp
    return at, out


def piece_starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The bytes at which the pattern's matches start, over all texts; matches never cross texts."""
    if not len(data):
        return np.zeros(0, np.int64)
    at, cp = code_points(data)
    n = len(at)
    kind = np.full(n + 3, 255, dtype=np.uint8)
    kind[:n] = classes()[cp]
    fresh = np.zeros(n + 3, dtype=bool)
    fresh[np.searchsorted(at, offs)] = True
    starts = fresh.copy()
    starts[0] = True
    starts[1:n] |= kind[1:n] != kind[: n - 1]
    run = starts.copy()
    run[n:] = True
    # the last blank before other text stands alone, or leads what follows if it is a space
    after = np.flatnonzero(run[1:n] & ~fresh[1:n] & (kind[: n - 1] == BLANK)) + 1
    starts[after - 1] = True
    starts[after[cp[after - 1] == 0x20]] = False
    # contractions
    q = np.flatnonzero((cp == 0x27) & starts[:n])
    q = q[run[q] & run[q + 1] & ~fresh[q + 1] & (kind[q + 1] == LETTER)]
    if len(q):
        pad = np.concatenate([cp, [0, 0, 0]])
        one = np.isin(pad[q + 1], [ord(c) for c in "stmd"])
        pair = pad[q + 1] * 256 + pad[q + 2]
        two = np.isin(pair, [ord(a) * 256 + ord(b) for a, b in ("re", "ve", "ll")]) & ~fresh[q + 2] & (pad[q + 2] < 256)
        for hit, size in ((q[one], 1), (q[two & ~one], 2)):
            starts[hit + 1] = False
            starts[hit + 1 + size] = True
    return at[np.flatnonzero(starts[:n])]


def unsure(data: np.ndarray) -> bool:
    """Whether any character's class is unsure."""
    return bool(len(data)) and bool((data >= 0xC2).any()) and bool((classes()[code_points(data)[1]] == UNSURE).any())


def joined(values: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """values[first[i] : first[i] + counts[i]] for every i, one after the other."""
    ends = np.cumsum(counts)
    return values[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - ends + counts, counts)]


class Spelling:
    """A byte string for each id, laid out for joined()."""

    def __init__(self, strings: Sequence[bytes]) -> None:
        self.size = np.array([len(x) for x in strings], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.data = np.frombuffer(b"".join(strings), dtype=np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        return joined(self.data, self.first[ids], self.size[ids])


class PieceTable:
    """Ids of pieces by the hash of their bytes; emptied when it holds ``most`` pieces."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], most: int = 1 << 19) -> None:
        self.encode, self.most = encode, most
        self._reset(1 << 14)

    def _reset(self, slots: int) -> None:
        self.keys, self.where = np.zeros(slots, dtype=_U), np.zeros(slots, dtype=np.int32)
        self.hashes, self.first, self.count = np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The number of each known piece, -1 for others."""
        mask = np.int64(len(self.keys) - 1)
        slot = (h >> _U(20)).astype(np.int64) & mask
        out = np.full(len(h), -1, dtype=np.int32)
        todo = np.arange(len(h))
        while len(todo):
            k = self.keys[slot]
            same = k == h[todo]
            out[todo[same]] = self.where[slot[same]]
            more = ~same & (k != 0)
            todo, slot = todo[more], (slot[more] + 1) & mask
        return out

    def _place(self, h: np.ndarray, number: np.ndarray) -> None:
        mask = np.int64(len(self.keys) - 1)
        slot = (h >> _U(20)).astype(np.int64) & mask
        todo = np.arange(len(h))
        while len(todo):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[todo[free]]  # of several at a slot the last stays
            won = self.keys[slot] == h[todo]
            self.where[slot[won]] = number[todo[won]]
            todo, slot = todo[~won], (slot[~won] + 1) & mask

    def _add(self, h: np.ndarray, pieces: list[bytes]) -> None:
        new = self.encode(pieces)
        count = np.array([len(x) for x in new], dtype=np.int64)
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.ids = np.concatenate([self.ids, np.array([i for x in new for i in x], dtype=np.int32)])
        self.hashes = np.concatenate([self.hashes, h])
        if 3 * len(self.hashes) > len(self.keys):
            slots = len(self.keys)
            while 4 * len(self.hashes) > slots:
                slots *= 2
            self.keys, self.where = np.zeros(slots, dtype=_U), np.zeros(slots, dtype=np.int32)
            self._place(self.hashes, np.arange(len(self.hashes), dtype=np.int32))
        else:
            self._place(h, np.arange(len(self.hashes) - len(h), len(self.hashes), dtype=np.int32))

    def encoded(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in order, and the count of each piece's ids."""
        h = span_hashes(data, starts, ends) | _U(1)
        if len(self.hashes) > self.most:
            self._reset(1 << 14)
        number = self._find(h)
        new = np.flatnonzero(number < 0)
        if len(new):
            some, at = np.unique(h[new], return_index=True)
            raw = data.tobytes()
            self._add(some, [raw[starts[i] : ends[i]] for i in new[at]])
            number[new] = self._find(h[new])
        count = self.count[number]
        return joined(self.ids, self.first[number], count), count


class Encoder:
    """Texts to ids: pre-tokenising, the table, and a check against the input's bytes."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], whole: Callable[[str], list[int]], tokens: Sequence[bytes], special: Sequence[bytes] = ()) -> None:
        """encode: ids of single pieces; whole: ids of a text, used where it holds characters of unsure class or a special token's string."""
        self.table, self.spelling = PieceTable(encode), Spelling(tokens)
        self._encode, self._whole, self._special = encode, whole, special

    def texts(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, and where each text's ids start (one more at the end)."""
        if unsure(data) or (self._special and any(x in data.tobytes() for x in self._special)):
            each = [self._whole(data[a:b].tobytes().decode()) for a, b in zip(offs[:-1], offs[1:], strict=True)]
            return np.array([i for x in each for i in x], dtype=np.int32), np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
        starts = piece_starts(data, offs)
        return self.pieces(data, starts, np.append(starts[1:], len(data)) if len(starts) else starts, offs)

    def pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, count = self.table.encoded(data, starts, ends)
        if not np.array_equal(self.spelling.of(ids), data[starts[0] : ends[-1]] if len(starts) else data[:0]):
            raw = data.tobytes()
            each = self._encode([raw[a:b] for a, b in zip(starts, ends, strict=True)])
            ids, count = np.array([i for x in each for i in x], dtype=np.int32), np.array([len(x) for x in each], dtype=np.int64)
        upto = np.concatenate([[0], np.cumsum(count)])
        return ids, upto[np.searchsorted(starts, offs)]
