"""XXH64 of many spans of a byte array at a time, after its public specification."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_P1, _P2, _P3, _P4, _P5 = (_U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << _U(r)) | (x >> _U(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rot(acc + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of data[start:end] for every span."""
    data = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    four = np.ndarray((len(data) - 3,), "<u4", data, strides=(1,))
    length, at, s = (ends - starts).astype(np.int64), starts.astype(np.int64), _U(seed)
    h = np.full(len(starts), s + _P5, dtype=_U)
    with np.errstate(over="ignore"):
        if len(big := np.flatnonzero(length >= 32)):
            p, n = at[big].copy(), length[big] // 32
            acc = [np.full(len(big), x, dtype=_U) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            for k in range(int(n.max())):
                on = np.flatnonzero(n > k)
                for i in range(4):
                    acc[i][on] = _round(acc[i][on], eight[p[on] + 8 * i])
                p[on] += 32
            x = _rot(acc[0], 1) + _rot(acc[1], 7) + _rot(acc[2], 12) + _rot(acc[3], 18)
            for a in acc:
                x = (x ^ _round(np.zeros_like(a), a)) * _P1 + _P4
            h[big], at[big] = x, p
        h += length.astype(_U)
        left = ends - at
        for _ in range(3):
            on = np.flatnonzero(left >= 8)
            if not len(on):
                break
            h[on] = _rot(h[on] ^ _round(np.zeros(len(on), _U), eight[at[on]]), 27) * _P1 + _P4
            at[on] += 8
            left[on] -= 8
        if len(on := np.flatnonzero(left >= 4)):
            h[on] = _rot(h[on] ^ four[at[on]].astype(_U) * _P1, 23) * _P2 + _P3
            at[on] += 4
            left[on] -= 4
        for _ in range(3):
            on = np.flatnonzero(left >= 1)
            if not len(on):
                break
            h[on] = _rot(h[on] ^ data[at[on]].astype(_U) * _P5, 11) * _P1
            at[on] += 1
            left[on] -= 1
        h ^= h >> _U(33)
        h *= _P2
        h ^= h >> _U(29)
        h *= _P3
        h ^= h >> _U(32)
    return h
