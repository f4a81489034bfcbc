"""Words, characters and rolling hashes of whole text columns, computed on Arrow's buffers with numpy.

A text column is one run of bytes with row bounds, so all words of many rows are found, hashed and combined into
word n-grams by a few array operations; there is no loop over words. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 16

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20240517).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = np.uint64(0x2545F4914F6CDD1D)
_R_INVERSE = np.uint64(pow(int(_R), -1, 1 << 64))

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over all output bits."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, kept for as many positions as were ever asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 1 << 16)
            for name, r in (("up", _R), ("down", _R_INVERSE)):
                a = np.full(m, r, np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


class Spans:
    """Prefix sums from which the hash of any run of items is read; a run's hash doesn't depend on where it starts."""

    def __init__(self, items: np.ndarray) -> None:
        up, self.down = _POWERS.get(len(items) + 1)
        self.sums = np.zeros(len(items) + 1, np.uint64)
        np.cumsum(items * up[:-1], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def chunks(column: pa.Array | pa.ChunkedArray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes, or of one row that is longer."""
    sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(total, total[a] + most, "right")) - 1)
        yield a, min(b, len(sizes))
        a = b


class Texts:
    """Bytes of a slice of a text column. bounds: row i is data[bounds[i]:bounds[i + 1]]."""

    def __init__(self, column: pa.Array, lower: bool = False) -> None:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_string()).fill_null("")
        self.rows = len(column)
        self.bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + self.rows + 1] if self.rows else np.zeros(1, np.int64)
        low, high = int(self.bounds[0]), int(self.bounds[-1])
        self.bounds = self.bounds - low
        raw = column.buffers()[2] if self.rows else None
        self.data = np.frombuffer(raw, np.uint8)[low:high] if raw is not None and high > low else np.zeros(0, np.uint8)
        if lower:
            self.data = _LOWER[self.data]

    def byte_spans(self) -> Spans:
        return Spans(_BYTE[self.data])


class Words(Texts):
    """Words are the runs of bytes other than space and \\x09-\\x0D.

    start, end: byte bounds of each word; first: number of words before each row, and the total; row: the row of each word.
    """

    def __init__(self, column: pa.Array, lower: bool = False) -> None:
        super().__init__(column, lower)
        inside = ~_SPACE[self.data]
        if n := len(inside):
            edge = np.zeros(n + 1, bool)
            edge[self.bounds] = True
            opens, closes = inside.copy(), inside.copy()
            opens[1:] &= ~inside[:-1] | edge[1:-1]
            closes[:-1] &= ~inside[1:] | edge[1:-1]
            self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, self.bounds)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(self.rows), self.counts)
        self.bytes = self.byte_spans()
        self.hash = self.bytes.hash(self.start, self.end)
        self.spans = Spans(self.hash)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions at which n words of one row begin, and the hashes of those words."""
        at = np.arange(max(0, len(self.row) - n + 1))
        at = at[self.row[at] == self.row[at + n - 1]]
        return at, self.spans.hash(at, at + n)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, start and hash of each run of n words; rows with fewer words, but some, have all their words as one run."""
        at, h = self.grams(n)
        few = np.flatnonzero((self.counts > 0) & (self.counts < n))
        if len(few):
            a = self.first[few]
            at, h = np.concatenate([at, a]), np.concatenate([h, self.spans.hash(a, a + self.counts[few])])
            order = np.argsort(at, kind="stable")
            at, h = at[order], h[order]
        return self.row[at], at, h
