"""Vectorised views of a batch of texts: one byte buffer, words, shingle and word hashes.

A batch of texts is one UTF-8 buffer with offsets, as Arrow keeps it, so that
all per-byte work is a few numpy passes over the whole batch. Word and chunk
hashes are polynomial prefix sums modulo 2**64 and finished with a mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

#: Bytes that end a word: space and the controls from tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 offsets; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    width = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def slices(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each (or one longer row)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, base, U64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=U64)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (two multiply-xorshift rounds)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def span_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of raw[start:end], equal for equal bytes wherever they stand."""
    sums = np.zeros(len(raw) + 1, U64)
    np.cumsum((raw.astype(U64) + U64(1)) * _power(_BASE, len(raw) + 1)[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(_BASE_INV, len(raw) + 1)[starts])


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run without white space, and the word count of each row."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    solid = ~SPACE[raw]
    change = np.empty(len(raw), bool)
    change[0] = solid[0]
    np.not_equal(solid[1:], solid[:-1], out=change[1:])
    first = np.zeros(len(raw) + 1, bool)
    first[offsets[:-1]] = True  # a word never runs into the next row
    starts = np.flatnonzero(solid & (change | first[:-1]))
    last = np.empty(len(raw), bool)
    last[-1] = True
    last[:-1] = ~solid[1:] | first[1:-1]
    ends = np.flatnonzero(solid & last) + 1
    counts = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    return starts, ends, counts


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, one after the other, and the n + 1 offsets.

    A-Z count as a-z. A shingle is ``size`` words in a row; a row with fewer words has them all as one.
    """
    low = LOWER[raw]
    starts, ends, counts = words(low, offsets)
    h = span_hash(low, starts, ends)
    at = np.concatenate(([0], np.cumsum(counts)))
    rows = len(counts)
    if not len(h):
        return np.zeros(0, U64), np.zeros(rows + 1, np.int64)
    row = np.repeat(np.arange(rows), counts)
    left = at[row + 1] - np.arange(len(h))  # words from here to the row's end
    acc = h * U64(0xD6E8FEB86659FD93)
    for k in range(1, size):
        take = left > k
        nxt = np.zeros(len(h), U64)
        nxt[:-k or None] = h[k:]
        acc = np.where(take, mix(acc ^ nxt) * U64(0xD6E8FEB86659FD93), acc)
    whole = (left >= size) | ((counts[row] < size) & (np.arange(len(h)) == at[row]))
    sh, srow = mix(acc[whole]), row[whole]
    bounds = np.searchsorted(srow, np.arange(rows + 1))
    for i in range(rows):
        sh[bounds[i] : bounds[i + 1]].sort()
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (srow[1:] != srow[:-1])
    sh, srow = sh[new], srow[new]
    return sh, np.concatenate(([0], np.cumsum(np.bincount(srow, minlength=rows)))).astype(np.int64)


def binary_column(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Rows values[offsets[i]:offsets[i+1]] as Arrow binary, without a copy per row."""
    data = np.ascontiguousarray(values)
    offs = (np.asarray(offsets) * data.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer(offs), pa.py_buffer(data)])


def fixed_rows(matrix: np.ndarray) -> pa.Array:
    """Each row of a matrix as Arrow binary."""
    n, k = matrix.shape
    return binary_column(matrix.reshape(-1), np.arange(n + 1) * k)


def long_lists(matrix: np.ndarray) -> pa.Array:
    """Each row of an integer matrix as a list of longs."""
    n, k = matrix.shape
    values = pa.array(np.ascontiguousarray(matrix).reshape(-1).view(np.int64))
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), values)
