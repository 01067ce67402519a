"""Word and window hashes of whole Arrow batches of texts, in numpy.

Hashes are polynomial, so that prefix sums give the hash of any stretch, over values from fixed random tables, and mixed at the
end. Byte work goes in pieces of bounded size; arrays of a text hold a few numbers a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
#: Texts are hashed together up to so many bytes; a longer one goes alone.
SLICE = 4 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse, modulo 2**64, as far as asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, b, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


class Hasher:
    """Two of different seeds together tell windows apart by 128 bits."""

    def __init__(self, seed: int = 1):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.table = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        self.bytes_, self.words_ = (Powers(int(rng.integers(0, 1 << 63)) * 2 + 1) for _ in range(2))

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of each stretch ``data[start:end]``; stretches ascend and none is empty."""
        out, i, n = np.empty(len(starts), np.uint64), 0, len(starts)
        while i < n:
            first = int(starts[i])
            j = max(i + 1, int(np.searchsorted(ends, first + PIECE, side="right")))
            size = int(ends[j - 1]) - first
            up, down = self.bytes_.to(size)
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum(self.table[data[first : first + size]] * up, out=sums[1:], dtype=np.uint64)
            a, b = starts[i:j] - first, ends[i:j] - first
            out[i:j] = mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
            i = j
        return out

    def windows(self, words: np.ndarray, length: int) -> np.ndarray:
        """A hash of each ``length`` words that follow each other; ``len(words) - length + 1`` of them."""
        n = len(words)
        if n < length:
            return np.zeros(0, np.uint64)
        out = np.empty(n - length + 1, np.uint64)
        for i in range(0, len(out), PIECE):
            part = words[i : min(n, i + PIECE + length - 1)]
            up, down = self.words_.to(len(part))
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * up, out=sums[1:], dtype=np.uint64)
            m = len(part) - length + 1
            out[i : i + m] = mixed((sums[length:] - sums[:m]) * down[:m] + np.uint64(length))
        return out


def find_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word ``[^\\x20\\x09-\\x0D]+``, and the number of its text; text i is ``data[offsets[i]:offsets[i + 1]]``."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)  # words do not reach over the ends of texts
    edge[offsets] = True
    fresh, last = word.copy(), word.copy()
    fresh[1:] &= ~word[:-1] | edge[1:-1]
    last[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(fresh), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def text_slices(column: pa.Array, lower: bool = False, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, row after the last, bytes, offsets)`` of a string column, in slices of about ``limit`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        part = data[offsets[i] : offsets[j]]
        yield i, j, _LOWER[part] if lower else part, offsets[i : j + 1] - offsets[i]
        i = j


def inside(doc: np.ndarray, length: int) -> np.ndarray:
    """Which windows of ``length`` words lie in one text, given each word's text."""
    return doc[: len(doc) - length + 1] == doc[length - 1 :] if len(doc) >= length else np.zeros(0, bool)


def first_of_runs(values: np.ndarray) -> np.ndarray:
    """Marks of the first of each run of equal values."""
    return np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.zeros(0, bool)
