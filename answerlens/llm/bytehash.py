"""Vectorised hashing of UTF-8 text columns: whole Arrow batches as one byte array, no Python loop over words.

A slice of bytes hashes as sum(T[byte] * B**i) modulo 2**64, taken from prefix sums and mixed, so that every word,
k-gram or byte window of a batch costs a few array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240613).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_STEP = np.random.default_rng(77).integers(1, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i for i < n, kept per worker."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes together, or one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def prefix(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[data] * powers(len(data))[0], out=out[1:])
    return out


def slice_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end] for arrays of starts and ends."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that don't cross rows."""
    edge = np.zeros(len(inside) + 1, dtype=bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words (runs without white space) and, per row, where its words begin."""
    data = LOWER[data]
    start, end = runs(~SPACE[data], offsets)
    return slice_hash(prefix(data), start, end), np.searchsorted(start, offsets)


def shingle_hashes(words: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and, per row, where they begin; a row of fewer words has one of them all."""
    count = np.diff(at)
    each = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(each)])
    out = np.zeros(begin[-1], dtype=np.uint64)
    full = count >= k
    if full.any():
        rows = np.flatnonzero(full)
        first = np.repeat(at[rows] - begin[rows], each[rows])
        slot = np.arange(each[rows].sum())
        slot += np.repeat(begin[rows] - np.concatenate([[0], np.cumsum(each[rows])[:-1]]), each[rows])
        pos = slot + first
        out[slot] = sum(words[pos + j] * _STEP[j] for j in range(k))
    for c in range(1, k):
        rows = np.flatnonzero(count == c)
        if len(rows):
            out[begin[rows]] = sum(words[at[rows] + j] * _STEP[j] for j in range(c)) + U(c)
    return mix(out), begin
