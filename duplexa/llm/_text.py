"""Vectorised text kernels shared by the corpus operators.

A batch of texts is one byte buffer with offsets (Arrow's own layout), so
words, their hashes and the hashes of word windows come from a handful of numpy
passes; there is no Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_M64 = (1 << 64) - 1
_WORD_BASE, _BYTE_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values (the public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_WORD_BASE))


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, shared by a worker's batches up to KEPT of them."""

    KEPT = 1 << 20

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.KEPT:
            return self._run(self.base, n), self._run(self.inverse, n)
        if n > len(self.up):
            size = min(self.KEPT, 1 << (n - 1).bit_length())
            self.up, self.down = self._run(self.base, size), self._run(self.inverse, size)
        return self.up[:n], self.down[:n]

    @staticmethod
    def _run(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)


_BYTE_POWERS, _WORD_POWERS = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)


def window_hashes(values: np.ndarray, size: int, powers: _Powers = _WORD_POWERS) -> np.ndarray:
    """Hash of each run of ``size`` consecutive values (length ``len(values) - size + 1``)."""
    n = len(values)
    if n < size:
        return np.empty(0, np.uint64)
    up, down = powers.get(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=total[1:])
    return mix((total[size:] - total[:-size]) * down[: n - size + 1])


def byte_window_hashes(buf: np.ndarray, size: int) -> np.ndarray:
    return window_hashes(_BYTE_VALUE[buf], size, _BYTE_POWERS)


@dataclass
class Words:
    """Words of a batch: byte ranges in ``buf`` and, for document i, word rows ``first[i]:first[i + 1]``."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, lower: bool = False) -> np.ndarray:
        if not len(self.start):
            return np.empty(0, np.uint64)
        values = (_BYTE_VALUE[_LOWER] if lower else _BYTE_VALUE)[self.buf]
        up, down = _BYTE_POWERS.get(len(values) + 1)
        values *= up[:-1]
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values, out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start])

    def inside(self, size: int) -> np.ndarray:
        """First words of the windows of ``size`` words that lie in one document."""
        n = len(self.start)
        ok = np.ones(max(0, n - size + 1), bool)
        for back in range(1, size):  # a window must not start in the last size-1 words of a document
            at = self.first[1:-1] - back
            at = at[(at >= 0) & (at < len(ok)) & (at >= self.first[:-2])]
            ok[at] = False
        return np.flatnonzero(ok)


def words(buf: np.ndarray, offsets: np.ndarray) -> Words:
    """Runs of bytes other than 0x20 and 0x09-0x0D, within each document."""
    word = ~_SPACE[buf]
    n = len(buf)
    starts, ends = word.copy(), word.copy()
    if n:
        starts[1:] &= ~word[:-1]
        ends[:-1] &= ~word[1:]
        cut = offsets[(offsets > 0) & (offsets < n)]
        starts[cut] |= word[cut]
        ends[cut - 1] |= word[cut - 1]
    start = np.flatnonzero(starts)
    return Words(buf, start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string column; null is the empty text."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each slice holds about ``most`` bytes of text, or one longer document."""
    for batch in batches:
        _, offsets = text_buffer(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


class Generations:
    """A cache of bounded size: when the young half is full, the old half goes."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def missing(self, keys: list) -> list:
        out = []
        for k in keys:
            if k not in self.young:
                if k in self.old:
                    self.young[k] = self.old[k]
                else:
                    out.append(k)
        return out

    def trim(self) -> None:
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}

    def clear(self) -> None:
        self.young, self.old = {}, {}
