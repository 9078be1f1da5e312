"""Texts of an Arrow batch as NumPy arrays: bytes, words and their 64-bit hashes, without a Python step for each word.

A word's hash is a polynomial of its bytes modulo 2^64, then mixed. Equal words have equal hashes; unequal ones
meet with a chance of about 2^-64 (texts built against the hash aside).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once, unless one text is longer.
CHUNK = 1 << 20
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
#: The hash of no word (mix keeps 0 only for 0): stands for the end of a text.
END = np.uint64(0)


def chunks(column: pa.Array | pa.ChunkedArray, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """first row, end row, bytes (uint8) and offsets (int64, from 0) of runs of rows with about `most` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi, raw[at[lo] : at[hi]], (at[lo : hi + 1] - at[lo]).astype(np.int64)
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z lower-cased) in order, and for each text the place of its first word; one more at the end."""
    n = len(offsets) - 1
    low = _LOWER[data]
    solid = ~_SPACE[low]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edges = offsets[:-1][offsets[:-1] < len(low)]
    first[edges] = solid[edges]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    at = np.flatnonzero(solid)
    rank = np.searchsorted(at, starts)  # of a word's first byte among the solid ones
    size = np.diff(np.append(rank, len(at)))
    within = np.arange(len(at)) - np.repeat(rank, size)
    power = np.ones(int(size.max()), np.uint64)
    power[1:] = _R
    power = np.multiply.accumulate(power)
    h = np.add.reduceat((low[at].astype(np.uint64) + np.uint64(1)) * power[within], rank)
    return mix(h), np.searchsorted(starts, offsets).astype(np.int64)
