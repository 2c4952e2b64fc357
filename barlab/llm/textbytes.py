"""Whole texts of an Arrow column as flat numpy byte arrays, in slices of bounded size."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20


@dataclass
class Slice:
    """Rows [first, last) of a column. Every text is followed by one newline, so that no word or line
    runs over the end of a text; ``off`` has the start of each text, and the end of the last."""
    first: int
    last: int
    data: np.ndarray
    off: np.ndarray


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[Slice]:
    """A null text is empty. A slice has at most ``limit`` bytes unless one text alone is longer."""
    if len(texts) == 0:
        return
    a = pc.binary_join_element_wise(pc.fill_null(texts, ""), "", "\n")
    kind = np.int64 if pa.types.is_large_string(a.type) else np.int32
    off = np.frombuffer(a.buffers()[1], dtype=kind)[a.offset:a.offset + len(a) + 1].astype(np.int64)
    data = np.frombuffer(a.buffers()[2], dtype=np.uint8)
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield Slice(i, j, data[off[i]:off[j]], off[i:j + 1] - off[i])
        i = j


def byte_table(pattern: bytes) -> np.ndarray:
    """True for the bytes listed."""
    t = np.zeros(256, dtype=bool)
    t[list(pattern)] = True
    return t


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# ASCII white space; every other byte belongs to a word.
WHITE = byte_table(b" \t\n\v\f\r")


def word_bounds(is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of word bytes. The last byte is never one."""
    edge = np.flatnonzero(np.diff(is_word.view(np.int8), prepend=np.int8(0)))
    return edge[0::2], edge[1::2]


def squeezed(s: Slice, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased words with one space after each; a newline ends each text. Also the new offsets."""
    keep = is_word.copy()
    keep[1:] |= is_word[:-1]
    ends = s.off[1:] - 1
    keep[ends] = True
    out = LOWER[s.data]
    out[~is_word] = 32
    out[ends] = 10
    kept = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], kept[s.off]


def counts_between(positions: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many of the sorted positions fall into each text."""
    return np.diff(np.searchsorted(positions, off))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, as many as asked for so far."""

    def __init__(self, base: int):
        self.base, self.inv = base, pow(base, -1, 1 << 64)
        self._up = self._down = np.ones(1, dtype=np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            m = 1 << int(n - 1).bit_length()
            for name, b in (("_up", self.base), ("_down", self.inv)):
                a = np.full(m, b, dtype=np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self._up[:n], self._down[:n]


class RollingHash:
    """Prefix sums of a polynomial: the hash of any stretch of the sequence in constant time."""

    def __init__(self, values: np.ndarray, powers: Powers):
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up[:-1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]


# The five primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotated(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def _lane(acc, x: np.ndarray) -> np.ndarray:
    return _rotated(acc + x * _P2, 31) * _P1


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of many stretches of one byte array; stretches may overlap. All advance together, lane by lane."""
    with np.errstate(over="ignore"):
        seed = np.uint64(seed)
        padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
        word = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))).view("<u8")[:, 0].astype(np.uint64)
        at, left = starts.astype(np.int64), (ends - starts).astype(np.int64)
        h = np.full(len(at), seed + _P5)
        long = np.flatnonzero(left >= 32)
        if len(long):
            acc = [np.full(len(long), v) for v in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
            pos, stripes = at[long], left[long] >> 5
            live = np.arange(len(long))
            while len(live):
                for k in range(4):
                    acc[k][live] = _lane(acc[k][live], word[pos[live] + 8 * k])
                pos[live] += 32
                stripes[live] -= 1
                live = live[stripes[live] > 0]
            x = _rotated(acc[0], 1) + _rotated(acc[1], 7) + _rotated(acc[2], 12) + _rotated(acc[3], 18)
            for a in acc:
                x = (x ^ _lane(np.uint64(0), a)) * _P1 + _P4
            h[long] = x
            at = at.copy()
            at[long] = pos
        h += left.astype(np.uint64)
        left = left & 31
        for need in (8, 16, 24):
            live = np.flatnonzero(left >= need)
            h[live] = _rotated(h[live] ^ _lane(np.uint64(0), word[at[live] + (need - 8)]), 27) * _P1 + _P4
        at, left = at + (left & 24), left & 7
        live = np.flatnonzero(left >= 4)
        h[live] = _rotated(h[live] ^ ((word[at[live]] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
        at, left = at + (left & 4), left & 3
        for need in (1, 2, 3):
            live = np.flatnonzero(left >= need)
            h[live] = _rotated(h[live] ^ (padded[at[live] + (need - 1)].astype(np.uint64) * _P5), 11) * _P1
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        return h ^ (h >> np.uint64(32))
