"""Whole columns of texts as flat NumPy arrays: word spans, hashes, runs. Helpers of tasks, no Spark here.

A batch of texts is one byte array and the bounds of its texts. Work goes in slices of a few MB, so memory
follows the slice and the longest single text, never the batch.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# The functions travel with the task, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

U64 = np.uint64
SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1

#: Bytes of words: all but the ASCII white space.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of words: ASCII letters and digits, and all of UTF-8 beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
for _lo, _hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    ALNUM[_lo : _hi + 1] = True
#: A-Z lower-cased, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values: equal in, equal out; a bijection."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a string or binary column; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


@dataclass
class Slice:
    """Texts ``first`` to ``last`` of a batch: their bytes, and bounds that start at 0."""

    first: int
    last: int
    data: np.ndarray
    bounds: np.ndarray


def slices(data: np.ndarray, bounds: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Runs of whole texts of at most ``limit`` bytes; a longer text stands alone."""
    first, n = 0, len(bounds) - 1
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield Slice(first, last, data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])
        first = last


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    return slices(*byte_column(column), limit)


def word_spans(data: np.ndarray, bounds: np.ndarray, of_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of word bytes, and the text of each; no run crosses a bound."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = of_word[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edges = bounds[1:-1]
    edges = edges[edges < len(data)]
    starts[edges] = inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = edges[edges > 0] - 1
    ends[last] = inside[last]
    start = np.flatnonzero(starts)
    return start, np.flatnonzero(ends) + 1, owner(start, bounds)


def owner(position: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The text that each (sorted) position lies in."""
    return np.searchsorted(bounds, position, side="right") - 1


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int, name: str = "up") -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, of the base or ("down") its inverse."""
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        base = _BASE if name == "up" else pow(_BASE, -1, 1 << 64)
        steps = np.full(max(n, SLICE_BYTES + 1), base, dtype=U64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=U64)
        if len(have) <= 2 * SLICE_BYTES:
            _POWERS[name] = have
    return have[:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Running sums from which ``span_hash`` takes the hash of any span. values: 64-bit codes of the symbols."""
    total = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * powers(len(values)), dtype=U64, out=total[1:])
    return total


def span_hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the symbols start to end: equal spans, equal hashes."""
    return mix((total[end] - total[start]) * powers(len(total), "down")[start] + (end - start).astype(U64))


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hash(prefix_hash(_BYTE[data]), start, end)


def text_hashes(part: Slice) -> np.ndarray:
    return byte_hashes(part.data, part.bounds[:-1], part.bounds[1:])


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys, and the length at the end."""
    if not len(sorted_keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]])


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every range, one after the other."""
    if not len(length) or not length.sum():
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(ends[-1]) + np.repeat(start - (ends - length), length)


def pack(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()
