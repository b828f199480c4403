"""Whole texts as arrays: words, their hashes, shingles and windows, a batch of rows at a time with numpy.

All hashes are 64-bit and seeded by constants, so that every worker agrees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are held as arrays at a time; a single longer text is one chunk of its own.
CHUNK = 1 << 18
#: A byte's value in a word's hash; 0 marks the six white space bytes.
EXACT = np.arange(1, 257, dtype=np.uint64)
EXACT[[32, 9, 10, 11, 12, 13]] = 0
FOLDED = EXACT.copy()
FOLDED[65:91] = FOLDED[97:123]

ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, a bijection of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(n: int, seed: int) -> np.ndarray:
    """n pseudo-random words."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * ODD)


@dataclass
class Words:
    """The words of some rows: byte ranges in data, the row of each, and each row's first word."""

    data: np.ndarray
    offsets: np.ndarray  # of rows in data, one more than rows
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    first: np.ndarray  # index of each row's first word, one more than rows

    def hashes(self, values: np.ndarray = EXACT, lane: int = 0) -> np.ndarray:
        """A hash of each word: a sum of its bytes' values times a random factor for each place."""
        length = self.ends - self.starts
        factor = stream(int(length.max(initial=0)), 1 + lane)
        out = np.empty(len(length), np.uint64)
        # A part of the words at a time: the numbers of a byte are far larger than it.
        size = np.cumsum(length)
        at = 0
        while at < len(length):
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK, "right")))
            part = self.data[self.starts[at] : self.ends[to - 1]]
            value = values[part]
            value = value[value != 0]
            begin = size[at:to] - length[at:to] - (size[at - 1] if at else 0)
            place = np.arange(len(value)) - np.repeat(begin, length[at:to])
            out[at:to] = mix(np.add.reduceat(value * factor[place], begin) + length[at:to].astype(np.uint64) * ODD)
            at = to
        return out

    def shingles(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words and the row of each; a row of 1 to n - 1 words is one run as a whole."""
        factor = stream(n, 77) | np.uint64(1)
        count = np.diff(self.first)
        many = max(0, len(hashes) - n + 1)
        total = np.zeros(many, np.uint64)
        for j in range(n):
            total += hashes[j : j + many] * factor[j]
        inside = self.row[:many] == self.row[n - 1 :] if many else np.zeros(0, bool)
        runs, rows = mix(total)[inside], self.row[:many][inside]
        short = np.flatnonzero((count > 0) & (count < n))
        if len(short):
            whole = [np.add.reduce(hashes[self.first[r] : self.first[r + 1]] * factor[: count[r]]) for r in short]
            whole = mix(np.array(whole, np.uint64) + count[short].astype(np.uint64) * ODD)
            runs = np.concatenate([runs, whole])
            rows = np.concatenate([rows, short])
            order = np.argsort(rows, kind="stable")
            runs, rows = runs[order], rows[order]
        return runs, rows


def rows_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the offsets of an Arrow string column without copying; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of at most `most` bytes, or one row: first, last, bytes and offsets from 0."""
    data, offsets = rows_of(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray, values: np.ndarray = EXACT) -> Words:
    """Words are runs of bytes that have a value."""
    inside = (values != 0)[data]
    before = np.empty(len(data), bool)
    after = np.empty(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    if len(data):
        before[0] = after[-1] = False
        before[edge] = False
        after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(starts, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, offsets, starts, ends, row, first)


def powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(0, n - 1), base, np.uint64))])


class Runs:
    """Hashes of any runs of words in constant time each: differences of a polynomial's prefix sums, modulo 2^64."""

    def __init__(self, hashes: np.ndarray, seed: int = 5):
        base = int(stream(1, seed)[0]) | 1
        n = len(hashes)
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(base, n)[:n])])
        self.down = powers(pow(base, -1, 1 << 64), n + 1)

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        size = np.asarray(length).astype(np.uint64)
        return mix((self.total[start + length] - self.total[start]) * self.down[start] + size * ODD)
