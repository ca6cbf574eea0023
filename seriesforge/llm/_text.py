"""Vectorised text primitives on Arrow string columns (numpy, no per-character Python).

Words are maximal runs of characters other than space and 0x09-0x0D; only A-Z
are lower-cased.  All of these are single bytes in UTF-8, so work is on bytes.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
#: Anything but letters, digits and bytes of other scripts.
NOT_ALNUM = np.array([not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128) for b in range(256)])
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def trim() -> None:
    """Give freed memory back to the system: Python workers live on after a task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def trims(of):
    """A task's generator that gives its memory back when it ends."""

    @functools.wraps(of)
    def run(*args, **named):
        try:
            yield from of(*args, **named)
        finally:
            trim()

    return run


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base, mod 2**64."""
    global _powers
    if len(_powers) < n:
        size = max(256, 1 << int(n - 1).bit_length())
        p = np.full(size, _BASE, np.uint64)
        p[0] = 1
        _powers = np.multiply.accumulate(p)
    return _powers


def inverse_powers(n: int) -> np.ndarray:
    """The first n powers of the inverse of the hash base, mod 2**64."""
    global _inverse
    if len(_inverse) < n:
        p = np.full(max(256, 1 << int(n - 1).bit_length()), pow(int(_BASE), -1, 1 << 64), np.uint64)
        p[0] = 1
        _inverse = np.multiply.accumulate(p)
    return _inverse


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, o, d = column.buffers()
    n = len(column)
    off = np.frombuffer(o, np.int64, n + 1, column.offset * 8) if o is not None else np.zeros(n + 1, np.int64)
    data = np.frombuffer(d, np.uint8) if d is not None and d.size else np.zeros(0, np.uint8)
    return data, off


def blocks(column, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about max_bytes (a longer row stands alone): first row, end row, bytes, offsets from 0."""
    data, off = utf8(column)
    n, a = len(off) - 1, 0
    while a < n:
        b = int(np.searchsorted(off, off[a] + max_bytes, "right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def of_bytes(table: np.ndarray, data: np.ndarray) -> np.ndarray:
    """``table[data]`` of a table of 256 bytes, without numpy's indices of eight bytes."""
    return np.frombuffer(data.tobytes().translate(table.tobytes()), table.dtype)


def bounds(data: np.ndarray, off: np.ndarray, sep: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of rows: starts and ends in data, and the first word of each row (n + 1 numbers)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    word = ~of_bytes(sep, data)
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    inner = off[(off > 0) & (off < len(data))]
    begins[inner] |= word[inner]
    ends_at = word.copy()
    ends_at[:-1] &= ~(word[1:] & ~begins[1:])
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends_at) + 1, np.searchsorted(starts, off).astype(np.int64)


def words(data: np.ndarray, off: np.ndarray, lower: bool = True, sep: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of rows: starts and ends in data, a 64-bit hash of each, and the first word of each row (n + 1 numbers)."""
    if lower:
        data = of_bytes(_LOWER, data)
    starts, ends, first = bounds(data, off, sep)
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64), first
    # white space after a word has value 0, so its power does not matter
    value = np.where(sep, np.uint64(0), _BYTE)[data[starts[0] :]]
    if len(data) <= CHUNK_BYTES:
        value *= powers(len(data))[starts[0] : len(data)]
        total = np.add.reduceat(value, starts - starts[0]) * inverse_powers(len(data))[starts]
    else:
        # a longer row: powers within each word, so that none of the whole length are kept
        span = np.diff(np.append(starts, len(data)))
        within = np.arange(starts[0], len(data), dtype=np.int64) - np.repeat(starts, span)
        longest = int((ends - starts).max())
        np.minimum(within, longest, out=within)
        total = np.add.reduceat(value * powers(longest + 1)[within], starts - starts[0])
    return starts, ends, mix(total + (ends - starts).astype(np.uint64)), first


def windows(h: np.ndarray, w: int) -> np.ndarray:
    """A 64-bit hash of each w consecutive hashes."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(w):
        out += h[j : j + n] * _STEP[j]
    return mix(out)


def shingle_sets(column, w: int = 5) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its w-word shingles; the whole sequence where it has fewer words."""
    for a, b, data, off in blocks(column):
        _, _, h, first = words(data, off)
        every = windows(h, w)
        for i in range(b - a):
            s, e = first[i], first[i + 1]
            if e - s >= w:
                yield np.unique(every[s : e - w + 1])
            elif e > s:
                yield mix((h[s:e] * _STEP[32 : 32 + e - s]).sum(dtype=np.uint64, keepdims=True) + np.uint64(e - s))
            else:
                yield np.zeros(0, np.uint64)
