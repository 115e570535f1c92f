"""Whole columns of text as numpy arrays: words, their hashes, and hashes of word windows.

The bytes of an Arrow string column are used where they lie.  Words are found
for a whole chunk of documents at once and hashed through prefix sums, so the
cost is a few nanoseconds a byte and no Python object is made for a word.
Chunks are cut at document ends, near ``CHUNK`` bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)

#: Byte tables: what separates words.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but letters and digits; bytes of other scripts are word bytes.
PUNCT = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = np.ones(size, np.uint64)
        done, step = 1, base % (1 << 64)
        while done < size:
            out[done : 2 * done] = out[:done] * np.uint64(step)
            step = step * step % (1 << 64)
            done *= 2
        have = _powers[base] = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def running_sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=out[1:])
    return out


def spans_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span [start, end) of the values behind ``sums``, alike wherever it stands."""
    back = powers(INVERSE, len(sums))
    return (sums[end] - sums[start]) * back[start]


@dataclass
class Chunk:
    """Words of rows ``lo`` to ``hi`` of a batch; ``first[i]`` is the first word of row lo + i."""

    lo: int
    hi: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    word: np.ndarray
    byte_sums: np.ndarray

    def sums(self) -> np.ndarray:
        return running_sums(self.word)

    def windows(self, sums: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of ``width`` words from each place, and whether the window stays in its row."""
        n = len(self.word) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        at = np.arange(n)
        inside = np.repeat(self.first[1:], np.diff(self.first))[:n] >= at + width
        return mix(spans_hash(sums, at, at + width)), inside


def texts(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each row (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if lower:
        column = pc.utf8_lower(column)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def chunks(column: pa.Array, breaks: np.ndarray, lower: bool = False, size: int = CHUNK) -> Iterator[Chunk]:
    data, offsets = texts(column, lower)
    rows, lo = len(offsets) - 1, 0
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield _chunk(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lo, hi, breaks)
        lo = hi


def _chunk(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, breaks: np.ndarray) -> Chunk:
    inside = ~breaks[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offsets[offsets < len(data)]] = False
    after[offsets[offsets > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    sums = running_sums(data.astype(np.uint64) + np.uint64(1))
    word = mix(spans_hash(sums, start, end) + (end - start).astype(np.uint64))
    return Chunk(lo, hi, data, start, end, np.searchsorted(start, offsets), word, sums)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def trimmed(run: Callable) -> Callable:
    """``run`` over record batches, giving the memory that its arrays had back to the system at the end of each task, as workers live on."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return task
