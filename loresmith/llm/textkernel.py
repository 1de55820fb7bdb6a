"""Vectorised word finding and hashing on the bytes of Arrow string arrays."""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes that are handled at a time; a longer text is one slice of its own.
SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: ASCII white space: blank and 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def release_memory() -> None:
    """Give freed pages back to the system; workers live on between tasks and would keep them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def frugal(run):
    """A function over batches that gives its memory back when its task ends."""

    @functools.wraps(run)
    def inner(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return inner


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), so that every bit depends on all."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@functools.lru_cache(2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        out = np.full(size, base, U)
        out[0] = 1
        return np.cumprod(out, dtype=U)

    return run(_BASE), run(_INVERSE)


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row bounds; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    if not (wide or pa.types.is_string(column.type)):
        column, wide = column.cast(pa.large_string()), True
    buffers = column.buffers()
    bounds = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[bounds[0] : bounds[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def slices(bounds: np.ndarray, most: int = SLICE):
    """(first row, end row) pairs of about ``most`` bytes."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def words(data: np.ndarray, bounds: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start, end and 64-bit hash of each run of bytes that are not white space; words never cross rows."""
    if lower:
        data = LOWER[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, U)
    gap = SPACE[data]
    before, after = np.empty_like(gap), np.empty_like(gap)
    before[0] = after[-1] = True
    before[1:], after[:-1] = gap[:-1], gap[1:]
    edges = bounds[1:-1]
    before[edges[edges < len(data)]] = True
    after[edges[edges > 0] - 1] = True
    start = np.flatnonzero(~gap & before)
    end = np.flatnonzero(~gap & after) + 1
    return np.searchsorted(bounds, start, "right") - 1, start, end, span_hashes(data, start, end)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes, from running sums of one polynomial."""
    power, inverse = _powers(1 << max(20, int(len(data) - 1).bit_length()))
    total = np.empty(len(data) + 1, U)
    total[0] = 0
    np.cumsum((data.astype(U) + U(1)) * power[: len(data)], dtype=U, out=total[1:])
    value = (total[end] - total[start]) * inverse[start]
    return mix(value + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of all items of spans, one span after another."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


def shingles(row: np.ndarray, value: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each run of ``size`` words; a row with fewer words, but not none, has one shingle of all its words."""
    if not len(row):
        return row, value
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    count = np.diff(np.r_[first, len(row)])
    factors = [U(x) for x in (0x8CB92BA72F3D8DD7, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
    factors += [U(pow(int(factors[0]), i, 1 << 64)) for i in range(2, size)]
    n, out = len(value) - size + 1, np.zeros(0, U)
    if n > 0:
        out = np.zeros(n, U)
        for k in range(size):
            out += mix(value[k : k + n] ^ factors[k])
        whole = row[:n] == row[size - 1 :]
        where = np.flatnonzero(whole)
    else:
        where = np.zeros(0, np.int64)
    short = np.flatnonzero(count < size)
    rest = np.zeros(len(short), U)
    for k in range(size - 1):
        has = count[short] > k
        rest[has] += mix(value[first[short[has]] + k] ^ factors[k])
    at = np.r_[where, first[short]]
    order = np.argsort(at, kind="stable")
    return row[at][order], mix(np.r_[out[where] if n > 0 else out, rest] + U(size))[order]
