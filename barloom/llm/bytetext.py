"""Texts of an Arrow batch as one byte array, with range hashes, words and tokens found by numpy.

Null texts count as empty everywhere.  Nothing here looks past a text's own border, and work goes
through chunks of a few MB, so memory does not grow with the batch; one long text is one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: White space that ends a word: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def batch_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): the column's UTF-8 bytes and n + 1 borders, without a copy per text."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, borders, data = column.buffers()
    offsets = np.frombuffer(borders, np.int64, len(column) + 1, column.offset * 8) if borders else np.zeros(1, np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts, about ``size`` bytes each."""
    data, offsets = batch_bytes(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits (a bijection)."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


class RangeHash:
    """64-bit hash of any byte range of a chunk in constant time, from running sums modulo 2**64."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 2**64, 256, U)
        self.base = int(rng.integers(0, 2**63, dtype=U)) * 8 + 5 & (2**64 - 1)
        self.up = self.down = np.zeros(0, U)

    def _powers(self, n: int) -> None:
        if len(self.up) <= n:
            n = max(n + 1, 1 << 16) * 5 // 4
            with np.errstate(over="ignore"):
                self.up, self.down = (np.cumprod(np.concatenate([[U(1)], np.full(n, b, U)]), dtype=U)
                                      for b in (self.base, pow(self.base, -1, 2**64)))

    def load(self, data: np.ndarray) -> "RangeHash":
        self._powers(len(data))
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(self.table[data] * self.up[:len(data)], dtype=U, out=self.sums[1:])
        return self

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U))

    def windows(self, width: int) -> np.ndarray:
        """Hashes of all ranges of ``width`` bytes; they also cross the borders of texts."""
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, U)


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the runs of bytes that are no ``space``; no word crosses texts."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    solid = ~space[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    borders = offsets[1:-1][offsets[1:-1] < len(data)]
    first[borders] = solid[borders]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = borders[borders > 0] - 1
    last[inner] = solid[inner]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; all else stays."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The positions start[0], start[0] + 1, ... of each range, one range after another."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(total)
