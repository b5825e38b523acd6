"""Vectorised access to the UTF-8 bytes of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
SLICE_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_POW = _powers(_BASE, 1 << 16)
_POW_HIGH = _powers(pow(_BASE, 1 << 16, 1 << 64), 1 << 16)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit lanes."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, last row + 1, bytes, bounds of each row in the bytes).

    Nulls count as empty texts.  A slice holds at most ``limit`` bytes, or one row.
    """
    column = column.fill_null("") if column.null_count else column
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]
        lo = hi


def word_ranges(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of the words of every row: starts, ends, and each row's bounds in them."""
    if not len(data):
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(bounds), np.int64)
    gap = SEPARATOR[data]
    fresh = np.empty(len(data), dtype=bool)
    fresh[0] = True
    fresh[1:] = gap[:-1]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    fresh[inner] = True
    last = np.empty(len(data), dtype=bool)
    last[-1] = True
    last[:-1] = gap[1:]
    last[inner - 1] = True
    starts = np.flatnonzero(fresh & ~gap)
    ends = np.flatnonzero(last & ~gap) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each non-empty byte range, independent of where it lies."""
    if not len(starts):
        return np.zeros(0, dtype=_U)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    pos = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(first, lens)
    value = data[pos + np.repeat(starts, lens)].astype(_U)
    value += _U(1)
    if int(lens.max()) <= len(_POW):
        value *= _POW[pos]
    else:
        value *= _POW[pos & 0xFFFF] * _POW_HIGH[pos >> 16]
    return mix64(np.add.reduceat(value, first) + lens.astype(_U) * _U(0xD6E8FEB86659FD93))


_ORDER = np.array([mix64(np.array([i + 1], dtype=_U))[0] | _U(1) for i in range(64)], dtype=_U)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``width``-word shingles of every row as sorted 64-bit hashes, with row bounds.

    A-Z count as lower case.  A row of fewer words has its whole sequence as
    its one shingle; a row without words has none.
    """
    low = LOWER[data]
    starts, ends, rows = word_ranges(low, bounds)
    words = range_hashes(low, starts, ends)
    counts = np.diff(rows)
    rolled = np.zeros(max(len(words) - width + 1, 0), dtype=_U)
    for j in range(width if len(rolled) else 0):
        rolled += mix64(words[j : j + len(rolled)] * _ORDER[j] + _ORDER[j + 16])
    rolled = mix64(rolled)
    sets, sizes = [], np.zeros(len(counts), dtype=np.int64)
    for i, n in enumerate(counts.tolist()):
        if not n:
            continue
        a = rows[i]
        if n >= width:
            own = np.unique(rolled[a : a + n - width + 1])
        else:
            parts = mix64(words[a : a + n] * _ORDER[:n] + _ORDER[16 : 16 + n])
            own = mix64(parts.sum(keepdims=True) + _ORDER[40 + n])
        sizes[i] = len(own)
        sets.append(own)
    flat = np.concatenate(sets) if sets else np.zeros(0, dtype=_U)
    return flat, np.concatenate([[0], np.cumsum(sizes)])
