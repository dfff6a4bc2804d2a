"""Vectorised helpers over the bytes of Arrow string columns, used inside tasks.

Words are maximal runs of bytes other than space and 0x09-0x0D, which on UTF-8
text is the same as ``[^\\x20\\x09-\\x0D]+`` on code points.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 21
#: glibc's names for the size from which arrays get pages of their own, and for what it keeps when freed; the first grows to _LARGEST by itself.
_MMAP_THRESHOLD, _TRIM_THRESHOLD, _LARGEST = -3, -1, 1 << 25
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def released(run: Callable, large: int = _LARGEST) -> Callable:
    """`run` over a task's batches; then what it has freed goes back to the system, since worker processes stay for later tasks. Arrays of over `large` bytes go back at once."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        libc = ctypes.CDLL(None)
        glibc = hasattr(libc, "malloc_trim")
        if glibc and large < _LARGEST:
            libc.mallopt(_MMAP_THRESHOLD, large), libc.mallopt(_TRIM_THRESHOLD, 2 * large)
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if glibc:
            if large < _LARGEST:
                libc.mallopt(_MMAP_THRESHOLD, _LARGEST), libc.mallopt(_TRIM_THRESHOLD, 2 * _LARGEST)
            libc.malloc_trim(0)

    return over


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (bijective for a fixed seed)."""
    with np.errstate(over="ignore"):
        h = h + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        h = (h ^ (h >> np.uint64(30))) * _M1
        h = (h ^ (h >> np.uint64(27))) * _M2
        return h ^ (h >> np.uint64(31))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the offsets of its rows; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) else b"")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes; a longer row stands alone. Bounds the memory a task needs."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def words(flat: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; a word never crosses a row."""
    inside = ~separators[flat]
    new_row = np.zeros(len(flat) + 1, bool)
    new_row[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | new_row[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | new_row[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hash(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each byte span: a polynomial over its bytes and its length, then mixed."""
    base = np.uint64((0x9E3779B97F4A7C15 + 2 * 0x632BE59BD9B4E019 * seed) & (2**64 - 1) | 1)
    length = ends - starts
    h = length.astype(np.uint64)
    active = np.flatnonzero(length > 0)
    k = 0
    with np.errstate(over="ignore"):
        while len(active):
            if len(active) < 8 and k > 64:  # few very long spans: blockwise instead of byte by byte
                for i in active:
                    h[i] = _long_hash(flat[starts[i] + k : ends[i]], base, h[i])
                break
            h[active] = h[active] * base + (flat[starts[active] + k].astype(np.uint64) + np.uint64(1))
            k += 1
            active = active[length[active] > k]
    return mix(h, seed)


def _long_hash(span: np.ndarray, base: np.uint64, h: np.uint64, block: int = 4096) -> np.uint64:
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(block, base, np.uint64))  # base**1 .. base**block
        for at in range(0, len(span), block):
            piece = span[at : at + block].astype(np.uint64) + np.uint64(1)
            m = len(piece)
            h = h * powers[m - 1] + (piece[:-1] * powers[: m - 1][::-1]).sum(dtype=np.uint64) + piece[-1]
    return h


def rolling(ids: np.ndarray, size: int, base: int) -> np.ndarray:
    """Hash of each run of `size` consecutive ids (runs may cross rows; callers mask those), by doubling."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    one = np.uint64(base | 1)
    power = [(ids, one)]  # hashes of runs of 1, 2, 4 ... and base ** that length
    with np.errstate(over="ignore"):
        while 2 ** len(power) <= size:
            h, p = power[-1]
            half = 2 ** (len(power) - 1)
            power.append((h[:-half] * p + h[half:], p * p))
        out, at = None, 0
        for k in reversed(range(len(power))):
            if size >> k & 1:
                h, p = power[k]
                part = h[at : at + n]
                out = part if out is None else out * p + part
                at += 2**k
    return out


def covered(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Which of `size` units the half-open intervals cover."""
    delta = np.zeros(size + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, ends, -1)
    return np.cumsum(delta[:-1]) > 0


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of True."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
