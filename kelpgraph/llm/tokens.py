"""Vectorised tokenising of Arrow batches, shared by the text operators.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which for UTF-8 is the pattern [^\\x20\\x09-\\x0D]+.
Work goes over *blocks* of whole documents of a few MB together, so memory depends on the block and on the longest
document, never on the partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

U = np.uint64
BLOCK_BYTES = 1 << 20
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants), elementwise."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _table(seed: int, n: int = 256) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


class Powers:
    """Powers of an odd multiplier modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = U(base), U(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, U)

    def _grow(self, n: int) -> None:
        size = max(n, 1 << 16)
        for name, base in (("up", self.base), ("down", self.inverse)):
            out = np.full(size, base, U)
            out[0] = 1
            setattr(self, name, np.multiply.accumulate(out))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums of values[i] * base**i; n + 1 of them."""
        if len(self.up) < len(values) + 1:
            self._grow(len(values) + 1)
        out = np.zeros(len(values) + 1, U)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def between(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the ranges [start, end), equal for equal sequences wherever they stand."""
        return mix((prefix[end] - prefix[start]) * self.down[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


BYTES, WORDS, WORDS2 = Powers(0x9E3779B97F4A7C15), Powers(0xC2B2AE3D27D4EB4F), Powers(0xD1342543DE82EF95)
_T = _table(0x1234567)


@dataclass
class Block:
    """Whole documents, their bytes and their words. rows: their places in the Arrow batch."""

    rows: slice
    data: np.ndarray
    start: np.ndarray  # of each document in data
    end: np.ndarray

    def __post_init__(self) -> None:
        word = ~_SEP[self.data]
        if not len(word):
            self.ws = self.we = np.zeros(0, np.int64)
        else:
            full = self.end > self.start
            begin, stop = word.copy(), word.copy()
            begin[1:] &= ~word[:-1]
            stop[:-1] &= ~word[1:]
            first, last = self.start[full], self.end[full] - 1
            begin[first] = word[first]
            stop[last] = word[last]
            self.ws, self.we = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.ws, np.append(self.start, len(self.data)))
        self.first[:-1] = np.searchsorted(self.ws, self.start)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    @cached_property
    def wdoc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.start)), self.n_words)

    def hashes(self, fold: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; with fold, A-Z count as a-z."""
        data = _FOLD[self.data] if fold else self.data
        return BYTES.between(BYTES.prefix(_T[data]), self.ws, self.we)

    def joined(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The kept words, a space after each, and where each document begins in that (n + 1 places)."""
        length = (self.we - self.ws + 1) * keep
        ends = np.cumsum(length)
        at = np.concatenate(([0], ends))[self.first]
        s, size = self.ws[keep], length[keep]
        where = np.repeat(s - (ends[keep] - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        out = np.append(self.data, np.uint8(32))[where]
        out[ends[keep] - 1] = 32
        return out, at


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The batch's rows in order, in blocks of about limit bytes; a null text is an empty one."""
    array = batch.column(column)
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if not len(array):
        return
    array = array.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    buffer = array.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(array):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        low, high = int(offsets[at]), int(offsets[to])
        yield Block(slice(at, to), data[low:high], offsets[at:to] - low, offsets[at + 1 : to + 1] - low)
        at = to


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, .. (length[0] of them), start[1], .. together."""
    total = int(length.sum())
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(total)


def cover(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each of n places is in any of the ranges [start, end)."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, start, 1)
    np.add.at(marks, end, -1)
    return np.cumsum(marks[:-1]) > 0


def lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Lengths of a list column's rows (null: 0) and their values together."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    length = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return length, column.flatten()
