"""Vectorised text kernels that run inside Arrow tasks: words, word hashes, shingles, whole-column helpers.

A "word" is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``, which is the same on UTF-8 bytes as on code points.
Hashes are 64 bits wide, fixed by constants below, and equal on every machine and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_GOLD = U64(0x9E3779B97F4A7C15)
_M1 = U64(0xBF58476D1CE4E5B9)
_M2 = U64(0x94D049BB133111EB)
#: Bytes of text handled at once inside a task.
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = x + _GOLD
    x = (x ^ (x >> U64(30))) * _M1
    x = (x ^ (x >> U64(27))) * _M2
    return x ^ (x >> U64(31))


_POS = 64
#: One random value for each (position within 64, byte).
_CELL = mix(np.arange(_POS * 256, dtype=U64) + U64(1))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without a copy; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of ``text``; a longer text is a slice of its own."""
    for batch in batches:
        _, offsets = text_bytes(batch.column(text))
        lo, n = 0, batch.num_rows
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
            yield batch.slice(lo, min(hi, n) - lo)
            lo = min(hi, n)
    pa.default_memory_pool().release_unused()  # the worker stays for tasks to come


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each document, one longer than the documents)."""
    full = ~_SPACE[raw]
    inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(raw))]
    begin = full.copy()
    begin[1:] &= ~full[:-1]
    begin[inner] = full[inner]
    stop = full.copy()
    stop[:-1] &= ~full[1:]
    stop[inner - 1] = full[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: a mixed sum of random cells chosen by position and byte."""
    if not len(starts):
        return np.zeros(0, U64)
    length = ends - starts
    total = int(length.sum())
    begin = np.cumsum(length) - length
    at = np.arange(total) - np.repeat(begin, length)
    value = _CELL[((at & (_POS - 1)) << 8) + raw[at + np.repeat(starts, length)]]
    if int(length.max()) > _POS:
        value = value * (mix((at >> 6).astype(U64)) | U64(1))
    return mix(np.add.reduceat(value, begin) ^ (length.astype(U64) * _GOLD))


def joined_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, begin of each word): the words, each followed by one space."""
    size = ends - starts + 1
    begin = np.cumsum(size) - size
    out = np.append(raw, np.uint8(32))[spans_index(starts, size)]
    out[begin + size - 1] = 32
    return out, begin


def spans_index(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Concatenated ranges ``first[i] .. first[i] + count[i] - 1``."""
    total = int(count.sum())
    return np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets by document) of all k-word shingles, in text order; fewer than k words give one shingle of them all."""
    count = np.diff(first)
    n = len(words)
    rolled = np.zeros(n, U64)
    step = np.zeros(n, U64)
    for j in range(k):
        take = n - j
        step[:take] = words[j:]
        rolled = mix(rolled * U64(3) + step + U64(j))
        step[:] = 0
    number = np.where(count >= k, count - k + 1, (count > 0).astype(count.dtype))
    out = rolled[spans_index(first[:-1], number)]
    offsets = np.concatenate([[0], np.cumsum(number)])
    for i in np.flatnonzero((count > 0) & (count < k)):
        h = U64(count[i])
        for w in words[first[i] : first[i + 1]]:
            h = mix(np.array([h], U64) * U64(3) + w)[0]
        out[offsets[i]] = h
    return out, offsets


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by sorting (numpy's own goes through a hash table, which is slower here)."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def windows_min(values: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each window of ``w`` values; fewer values are one window."""
    n = len(values)
    if n <= w:
        return values.min(keepdims=True) if n else values
    pad = -n % w
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    block = np.concatenate([values, np.full(pad, top, U64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def rolling(raw: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values, by doubling: h(2m) joins two h(m); k need not be a power of two."""
    n = len(raw) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    h, m = mix(raw.astype(U64)), 1
    while 2 * m <= k:
        h = mix(h[:-m] * U64(3) + h[m:])
        m *= 2
    return mix(h[:n] * U64(5) + h[k - m : k - m + n]) if m < k else h
