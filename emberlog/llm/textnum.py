"""Vectorised work on Arrow text columns: words, lines and hashes as numpy arrays.

All functions take the UTF-8 bytes of a whole batch at once; nothing loops over
words in Python.  Words are runs of bytes other than the six ASCII white-space
bytes, so a multi-byte character never ends a word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
WORD = ~SPACE
#: A worker holds some fifty bytes for each byte of a slice; larger slices are no faster.
SLICE_BYTES = 1 << 20
_LIBC = ctypes.CDLL(None)

_R = np.uint64(0x9E3779B97F4A7C13)  # 3 mod 8: powers stay far apart modulo 2**64
_RI = np.uint64(pow(int(_R), -1, 1 << 64))
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = _BYTE.copy()
_FOLD[65:91] = _BYTE[97:123]
_power: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_power[0]) < n:
        size = max(n, SLICE_BYTES + 65536)
        for k, r in enumerate((_R, _RI)):
            table = np.full(size, r, np.uint64)
            table[0] = 1
            _power[k] = np.cumprod(table, dtype=np.uint64)
    return _power[0], _power[1]


class Texts:
    """The texts of some rows: their bytes, one after the other, and offsets."""

    def __init__(self, column: pa.Array):
        if column.null_count:
            column = pc.fill_null(column, "")
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        n, wide = len(column), pa.types.is_large_string(column.type)
        _, offs, data = column.buffers()
        if n == 0 or offs is None:
            self.offs, self.data = np.zeros(n + 1, np.int64), np.zeros(0, np.uint8)
        else:
            offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
            data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
            self.offs, self.data = offs - offs[0], data[offs[0] : offs[-1]]
        self._sums: dict[bool, np.ndarray] = {}
        self._words: tuple | None = None

    def __len__(self) -> int:
        return len(self.offs) - 1

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of maximal runs of true bytes that don't cross texts."""
        n = len(inside)
        if n == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        full = self.offs[1:] > self.offs[:-1]
        first, last = self.offs[:-1][full], self.offs[1:][full] - 1
        begin[first] = inside[first]
        end[last] = inside[last]
        return np.flatnonzero(begin), np.flatnonzero(end) + 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of words, and per text the number of the first (n + 1 values)."""
        if self._words is None:
            starts, ends = self.spans(WORD[self.data])
            self._words = starts, ends, np.searchsorted(starts, self.offs)
        return self._words

    def hashes(self, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
        """A 64-bit hash of each byte span; fold takes A-Z as a-z."""
        if fold not in self._sums:
            power, _ = _powers(len(self.data) + 1)
            sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((_FOLD if fold else _BYTE)[self.data] * power[: len(self.data)], out=sums[1:])
            self._sums[fold] = sums
        sums, (_, back) = self._sums[fold], _powers(len(self.data) + 1)
        return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many of the bytes' flags are set in each text."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.offs[1:]] - sums[self.offs[:-1]]


def windows(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words that stay in one text, and the number of each run's
    first word.  first: per text the number of its first word (n + 1 values)."""
    total = len(hashes) - k + 1
    if total <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(total, np.uint64)
    for j in range(k):
        out = out * _R + hashes[j : j + total]
    whole = np.zeros(len(hashes) + 1, np.int32)
    counts = np.diff(first)
    long = counts >= k
    np.add.at(whole, first[:-1][long], 1)
    np.add.at(whole, first[1:][long] - k + 1, -1)
    at = np.flatnonzero(np.cumsum(whole[:total]) > 0)
    return mix(out[at]), at


def give_back() -> None:
    """Return to the system what numpy and Arrow have freed: a worker lives for many tasks, and an executor has several."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):  # glibc's
        _LIBC.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about size text bytes; one longer text is a piece of its own.

    After each batch, what its pieces have freed goes back to the system.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, base = 0, 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, base + size, side="right")))
            yield batch.slice(at, to - at)
            at, base = to, int(ends[to - 1])
        del batch
        give_back()


def owner(first: np.ndarray, n: int) -> np.ndarray:
    """The number of the text that each of n items belongs to; first has n + 1 bounds."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
