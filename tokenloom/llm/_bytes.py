"""Vectorised work on the UTF-8 bytes of Arrow string columns."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = column.type
    wide = pa.types.is_large_string(kind) or pa.types.is_large_binary(kind)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(kind) or pa.types.is_large_binary(kind) else "")
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def give_back() -> None:
    """Return freed memory to the system, as Python workers live on from task to task and beside others in one executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most so many bytes of text, or a single row; memory is given back at the end."""
    for batch in batches:
        _, off = utf8(batch.column(text))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(off, off[row] + most, "right")) - 1)
            yield batch.slice(row, end - row)
            row = end
    give_back()


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that don't cross a document's end: starts, ends, and for each document the index of its first run."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def table(seed: int) -> np.ndarray:
    """A random 64-bit value for each byte."""
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class SpanHash:
    """64-bit hashes of many spans of one buffer: prefix sums of byte values times powers of an odd base."""

    BASE = 0x2545F4914F6CDD1D
    INVERSE = pow(BASE, -1, 2**64)
    _powers: dict[int, np.ndarray] = {}

    def __init__(self, buf: np.ndarray, seed: int = 7):
        n = len(buf)
        up = self.powers(self.BASE, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(table(seed)[buf] * up[:n], out=self.sums[1:])
        self.down = self.powers(self.INVERSE, n + 1)

    @classmethod
    def powers(cls, base: int, n: int) -> np.ndarray:
        have = cls._powers.get(base)
        if have is None or len(have) < n:
            full = np.full(max(n, 1 << 16), base, np.uint64)
            full[0] = 1
            have = cls._powers[base] = np.cumprod(full)
        return have[:n]

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.down[lo] + (hi - lo).astype(np.uint64))
