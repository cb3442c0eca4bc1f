"""Vectorised words, word hashes and hashes of word sequences over Arrow columns of text.

Words are runs of bytes other than space and the bytes 9 to 13, over UTF-8. All functions work on
whole columns at once; memory is a small multiple of the column's bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words hashed at once.
PIECE = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
BASE = U(0xD6E8FEB86659FD93)
_power = np.ones(1, U)


def powers(n: int) -> np.ndarray:
    global _power
    if len(_power) < n:
        p = np.full(max(n, 64), BASE, U)
        p[0] = 1
        _power = np.cumprod(p, dtype=U)
    return _power


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows in them; null rows are empty."""
    column = column.fill_null("") if column.null_count else column
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


class Words:
    """Words of a column: byte spans, index of each row's first word (and the end), 64-bit hashes."""

    def __init__(self, column: pa.Array, lower: bool = False, space: np.ndarray = SPACE):
        raw, at = buffer(column)
        self.data = LOWER[raw] if lower else raw
        n = len(raw)
        space = space[raw]
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        begin, end = ~space, ~space
        begin[1:] &= space[:-1] | edge[1:n]
        end[:-1] &= space[1:] | edge[1:n]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, at)
        self.counts = np.diff(self.first)

    def hashes(self, longest: int | None = None) -> np.ndarray:
        """A hash of each word, or of its first ``longest`` bytes."""
        out = np.empty(len(self.starts), U)
        for i in range(0, len(out), PIECE):
            s = self.starts[i : i + PIECE]
            size = self.ends[i : i + PIECE] - s
            if longest is not None:
                size = np.minimum(size, longest)
            at = np.cumsum(size) - size
            rel = np.arange(at[-1] + size[-1]) - np.repeat(at, size)
            got = BYTE[self.data[rel + np.repeat(s, size)]] * powers(int(size.max()))[rel]
            out[i : i + PIECE] = mix(np.add.reduceat(got, at) + size.astype(U))
        return out

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def grams(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of the k words from each word on; the last k - 1 are left out."""
    n = max(0, len(hashes) - k + 1)
    out = np.full(n, (seed * 0x9E3779B97F4A7C15 + k) & 0xFFFFFFFFFFFFFFFF, U)
    step = mix(np.array([seed + 77], U))[0] | U(1)
    for j in range(k):
        out *= step
        out += hashes[j : j + n]
    return mix(out)


def whole(first: np.ndarray, k: int) -> np.ndarray:
    """Which of the sequences of ``grams`` lie in one row."""
    n = max(0, int(first[-1]) - k + 1)
    return np.arange(n) + k <= np.repeat(first[1:], np.diff(first))[:n]


def place(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash, by its upper half."""
    return (((hashes >> U(32)) * U(buckets)) >> U(32)).astype(np.int32)
