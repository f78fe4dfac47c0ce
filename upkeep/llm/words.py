"""Words of whole texts as numpy arrays, straight from Arrow string buffers.

Separators are ASCII bytes, so UTF-8 texts can be cut byte-wise: a word is a
maximal run of bytes outside {0x20, 0x09-0x0D}. Every word gets a 64-bit
polynomial hash (prefix sums over the bytes, then a bit mixer), so shingles
and windows need no Python loop. Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_CHUNK = 1 << 20

_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (public-domain splitmix64 step)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _tables(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        n = max(n, 2 * _CHUNK)
        step = np.full(n, _BASE, np.uint64)
        step[0] = 1
        back = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        back[0] = 1
        _powers, _inverse = np.multiply.accumulate(step), np.multiply.accumulate(back)


class Words:
    """Words of a run of texts: byte data, word starts and ends, and for text i
    the words ``first[i]:first[i + 1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        token = ~_SPACE[data]
        start = token.copy()
        start[1:] &= ~token[:-1]
        end = token.copy()
        end[:-1] &= ~token[1:]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        start[inner] = token[inner]
        end[inner - 1] = token[inner - 1]
        self.start = np.flatnonzero(start)
        self.end = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, offsets)

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        _tables(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _powers[:n], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * _inverse[self.start])

    def strings(self, i: int) -> list[bytes]:
        lo, hi = self.first[i], self.first[i + 1]
        if lo == hi:
            return []
        return self.data[self.start[lo]:self.end[hi - 1]].tobytes().split()


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words (len - size + 1 of them)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    factor = 1
    for j in range(size):
        factor = factor * 0xD6E8FEB86659FD93 & (1 << 64) - 1
        total += hashes[j:j + n] * np.uint64(factor)
    return mix(total)


def runs(column: pa.Array | pa.ChunkedArray, lower: bool = False, chunk: int = _CHUNK) -> Iterator[tuple[int, int, Words]]:
    """Cut a text column into runs of about ``chunk`` bytes (one text at least,
    always whole texts): yields (first row, last row + 1, Words)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + chunk, "right")) - 1)
        stop = min(stop, len(column))
        part = data[offsets[row]:offsets[stop]]
        yield row, stop, Words(_LOWER[part] if lower else part, offsets[row:stop + 1] - offsets[row])
        row = stop


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs ``values[start:end]`` of a sequence of numbers."""
    n = len(values)
    _tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((values + np.uint64(1)) * _powers[:n], out=sums[1:])
    return mix((sums[end] - sums[start]) * _inverse[start])
