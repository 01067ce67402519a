"""Reads and what they add up to as arrays, for tasks that work on Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .exact import halves

CODE = np.full(256, -1, np.int8)
for _i, _pair in enumerate(("Aa", "Cc", "Gg", "TtUu")):
    for _c in _pair:
        CODE[ord(_c)] = _i


def kind(letters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in letters]] = True
    return out


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each value begins and ends; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8), offsets


def ragged(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of ``counts`` values that begin at ``starts``: the row, and the place, of each value."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)


def by_position(tid: np.ndarray, pos: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The different references and positions, and the sums there of the two ``halves`` of each of ``values``, one after the other. Few positions that come again and again are counted in place, without a sort."""
    if not len(tid):
        return tid, pos, [np.zeros(0)] * (2 * len(values))
    low, width = int(pos.min()), int(pos.max()) - int(pos.min()) + 1
    first, tids = int(tid.min()), int(tid.max()) - int(tid.min()) + 1
    if tids * width <= 4 * len(tid):
        key = (tid - first) * width + pos - low
        there = np.flatnonzero(np.bincount(key, minlength=tids * width))
        sums = [np.bincount(key, x, tids * width)[there] for v in values for x in halves(v)]
        return there // width + first, there % width + low, sums
    found, back = np.unique(tid << 40 | pos, return_inverse=True)
    return found >> 40, found & ((1 << 40) - 1), [np.bincount(back, x, len(found)) for v in values for x in halves(v)]
