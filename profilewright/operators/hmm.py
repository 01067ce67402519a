"""Reads spread over their plausible placements: a pair hidden Markov model, banded around each read's alignment.

Spark deals out the reads and sums what comes back; in a task, batches of reads go through the recurrences together as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.scalars import reference_span
from ..joins import ascii_only, with_stretch
from .arrays import CODE, by_position, kind, ragged, strings

OK, NO_PATH = "ok", "no path"
#: Cells of one batch of reads; positions to a side of the squares in which pairs are summed, and squares held at once.
CELLS, SQUARE, SQUARES = 1 << 19, 256, 24
TOLERANCE = 1e-6


@dataclass(frozen=True)
class Model:
    """Chances of the model and weights of what counts as a mutation."""

    open_deletion: float = scalars.OPEN_DELETION
    open_insertion: float = scalars.OPEN_INSERTION
    extend_deletion: float = scalars.EXTEND_DELETION
    extend_insertion: float = scalars.EXTEND_INSERTION
    modification: float = scalars.MODIFICATION
    substitution_weight: float = 1.0
    deletion_weight: float = 1.0
    insertion_weight: float = 0.0

    def __post_init__(self):
        if not all(0 <= x <= 1 for x in vars(self).values()) or self.open_deletion + self.open_insertion > 1:
            raise ValueError("chances and weights lie in 0-1, and the two openings sum to 1 at most")


_MATCH, _GAP, _CLIP = kind("M=X"), kind("DN"), kind("SHP")


class Reads:
    """The reads of an Arrow batch with the places of their bases, worked out for all together.

    After each placed base, and before the first, ``first`` and ``last`` are the reference bases passed before and after a
    deletion there; read k has the values from ``edges[k]`` on, one more than it has placed bases.
    """

    def __init__(self, batch: pa.RecordBatch):
        self.tid, self.pos = (np.asarray(batch.column(c), np.int64) for c in ("tid", "pos"))
        self.n = n = len(self.tid)
        kinds, kind_at = strings(batch.column("kinds"))
        lens = batch.column("lens")
        size = np.asarray(lens.flatten(), np.int64)
        counts = np.diff(kind_at)
        owner, at = ragged(kind_at[:-1], counts)
        op = kinds[at]
        core = np.flatnonzero(~_CLIP[op])
        begin, end = np.full(n, len(op)), np.zeros(n, np.int64)
        np.minimum.at(begin, owner[core], core)
        np.maximum.at(end, owner[core], core + 1)
        place = np.arange(len(op))
        soft = np.where(op == ord("S"), size, 0)
        lead = np.bincount(owner, soft * (place < begin[owner]), n).astype(np.int64)
        tail = np.bincount(owner, soft * (place >= end[owner]), n).astype(np.int64)
        taken, passed = np.where(_MATCH[op] | (op == ord("I")), size, 0), np.where(_MATCH[op] | _GAP[op], size, 0)
        before = lambda x: np.cumsum(x) - x - np.repeat((np.cumsum(x) - x)[np.minimum(np.cumsum(counts) - counts, max(0, len(x) - 1))], counts) if len(x) else x
        ref, query = self.pos[owner] + before(passed), before(taken)
        self.bases = np.bincount(owner, taken, n).astype(np.int64)
        self.edges = np.concatenate([[0], np.cumsum(self.bases + 1)])
        self.first = np.empty(int(self.edges[-1]), np.int64)
        self.first[self.edges[:-1]] = self.pos
        which, k = ragged(np.zeros(len(op), np.int64), taken)
        self.first[self.edges[owner[which]] + 1 + query[which] + k] = ref[which] + np.where(_MATCH[op[which]], k + 1, 0)
        self.last = self.first.copy()
        gap = np.flatnonzero(_GAP[op])
        self.last[self.edges[owner[gap]] + query[gap]] = ref[gap] + size[gap]  # of several that follow each other, the last stays
        self.seq, seq_at = strings(batch.column("seq"))
        self.seq_at = seq_at[:-1] + lead
        if (np.diff(seq_at) - lead - tail != self.bases).any():
            raise ValueError("a read's sequence does not have the length of its alignment")
        self.has_quality = np.asarray(batch.column("qual").is_valid())
        self.qual, qual_at = strings(batch.column("qual"))
        self.qual_at = qual_at[:-1] + lead
        self.stretch, self.stretch_at = strings(batch.column("stretch"))
        self.stretch_from, self.ref_len = (np.asarray(batch.column(c), np.int64) for c in ("stretch_from", "ref_len"))
        self.band = None
        if "band" in batch.schema.names:
            given = batch.column("band")
            if (np.asarray(given.value_lengths()) != self.bases + 1).any():
                raise ValueError("a band needs a half-width for each placed base and one before the first")
            self.band = np.asarray(given.flatten(), np.int64)
        spread = np.maximum.reduceat(self.last - self.first, self.edges[:-1]) if n else np.zeros(0, np.int64)
        self.width = spread + (2 * np.maximum.reduceat(self.band, self.edges[:-1]) if self.band is not None and n else 0)

    def batches(self, band: int) -> Iterator[np.ndarray]:
        """Reads of like length, band and alignment together, each batch of bounded size; one huge gap does not widen the others."""
        shape = np.add.reduceat(self.first, self.edges[:-1]) - self.pos * (self.bases + 1) if self.n else self.pos
        order = np.lexsort((shape, self.bases, self.width))
        rows, width = self.bases[order] + 1, self.width[order] + 2 * band + 1
        i = 0
        while i < self.n:
            cells = np.maximum.accumulate(rows[i:]) * np.maximum.accumulate(width[i:]) * np.arange(1, self.n - i + 1)
            j = i + max(1, int(np.searchsorted(cells, CELLS, side="right")))
            yield order[i:j]
            i = j


class Batch:
    """Some reads as padded arrays, row i for the i-th placed base; the band of row i starts at ``low``."""

    def __init__(self, reads: Reads, chosen: np.ndarray, band: int, min_phred: int, m: float):
        n, self.n_bases = len(chosen), reads.bases[chosen]
        rows = int(self.n_bases.max()) + 1
        real = np.arange(rows) <= self.n_bases[:, None]
        at = reads.edges[chosen][:, None] + np.minimum(np.arange(rows), self.n_bases[:, None])
        first, last = reads.first[at], np.where(real, reads.last[at], reads.first[at])
        half = band if reads.band is None else np.where(real, reads.band[at], 0)
        self.low, self.width = first - half, last - first + 2 * half + 1
        self.cells = np.arange(int(self.width.max()))
        self.origin = self.low.min(axis=1) - 1
        self.window = int(((self.low + self.width).max(axis=1) - self.origin).max()) + 2
        self.ref_len = reads.ref_len[chosen]
        placed = real[:, 1:]
        step = np.arange(rows - 1)
        base, error = np.full((n, rows), -1, np.int8), np.zeros((n, rows))
        base[:, 1:][placed] = CODE[reads.seq[(reads.seq_at[chosen][:, None] + step)[placed]]]
        known = placed & reads.has_quality[chosen][:, None]
        q = np.arange(256.0) - 33
        errors = np.where(q < min_phred, scalars.WORST_ERROR, np.minimum(scalars.WORST_ERROR, 10 ** (-q / 10)))
        error[:, 1:][known] = errors[reads.qual[(reads.qual_at[chosen][:, None] + step)[known]]]
        same = (1 - m) * (1 - error) + m * error / 3
        other_mod = m * (1 - error / 3) / 3
        other = (1 - m) * error / 3 + other_mod
        with np.errstate(divide="ignore", invalid="ignore"):
            share_same, share_other = np.where(same > 0, m * error / 3 / same, 0.0), np.where(other > 0, other_mod / other, 0.0)
        self.base, *self.chances = (np.ascontiguousarray(x.T) for x in (base, same, other, share_same, share_other))
        # Codes of the reference under the window (positions, reads): -1 is no letter, -2 is outside.
        at = self.origin[:, None] + np.arange(self.window + len(self.cells))
        stretch_at = reads.stretch_at[:-1][chosen][:, None]
        there = at - reads.stretch_from[chosen][:, None]
        seen = (there >= 0) & (there < reads.stretch_at[1:][chosen][:, None] - stretch_at)
        letters = np.append(reads.stretch, np.uint8(0))
        ref = CODE[letters[np.where(seen, there + stretch_at, len(letters) - 1)]]
        self.ref = np.ascontiguousarray(np.where((at >= 0) & (at < self.ref_len[:, None]), ref, np.int8(-2)).T)
        self.row_width = self.width.max(axis=0).tolist()
        self.moves = [(0, np.zeros(0, np.int64)), *most_of_each(np.diff(self.low, axis=1))]
        self.begins = most_of_each(self.low - 1 - self.origin[:, None])
        self.valid = self.cells[:, None] < self.width.T[:, None, :]

    def emission(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Of row i (cells, reads): the chance of its base before each reference prefix, and its share of a modification."""
        usual, odd = self.begins[i]
        w, base = self.row_width[i], self.base[i]
        ref = self.ref[usual : usual + w]
        if len(odd):
            ref = ref.copy()
            ref[:, odd] = self.ref[np.arange(w)[:, None] + (self.low[odd, i] - 1 - self.origin[odd]), odd]
        same, other, share_same, share_other = (x[i] for x in self.chances)
        agree, unnamed = ref == base, (ref < 0) | (base < 0)
        emit, share = np.where(agree, same, other), np.where(agree, share_same, share_other)
        np.putmask(emit, unnamed, 0.25)
        np.putmask(share, unnamed, 0.0)
        np.putmask(emit, ref == -2, 0.0)
        return emit, share

    def shifted(self, values: np.ndarray, i: int, to: int, by: int) -> np.ndarray:
        """Values (cells, reads) of row i under the cells of row ``to``, ``by`` prefixes on. Most reads move alike from row to row; the others are looked up."""
        usual, odd = self.moves[max(i, to)]
        usual = (usual if to > i else -usual) + by
        w, wide = len(values), self.row_width[to]
        out = np.zeros((wide, values.shape[1]))
        begin, end = max(0, -usual), min(wide, w - usual)
        if begin < end:
            out[begin:end] = values[begin + usual : end + usual]
        if len(odd):
            at = np.arange(wide)[:, None] + (self.low[odd, to] - self.low[odd, i] + by)
            ok = (at >= 0) & (at < w)
            out[:, odd] = np.where(ok, np.take_along_axis(values[:, odd], np.clip(at, 0, w - 1), axis=0), 0.0)
        return out

    def add(self, out: np.ndarray, values: np.ndarray, i: int) -> None:
        """Add values (kinds, cells, reads) of row i to windows (kinds, positions, reads)."""
        usual, odd = self.begins[i]
        if len(odd):  # the cells of a read are different positions, so plain indexing adds each once
            begin = self.low[odd, i] - 1 - self.origin[odd]
            out[:, np.arange(values.shape[1])[:, None] + begin, odd] += values[:, :, odd]
            values[:, :, odd] = 0
        out[:, usual : usual + values.shape[1]] += values


def most_of_each(moves: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Of each column, the most frequent value, and where the others stand."""
    alike = (moves == moves[0]).all(axis=0)
    out = [(usual, np.zeros(0, np.int64)) for usual in moves[0].tolist()]
    for k in np.flatnonzero(~alike):
        column = moves[:, k]
        values, n = np.unique(column, return_counts=True)
        usual = int(values[n.argmax()])
        out[k] = usual, np.flatnonzero(column != usual)
    return out


def posteriors(b: Batch, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Windows (3, reads, positions from ``origin``) of coverage, span and mutations; and which reads have a path."""
    mi, md, ii, dd = model.open_insertion, model.open_deletion, model.extend_insertion, model.extend_deletion
    mm, im, dm = 1 - mi - md, 1 - ii, 1 - dd
    n, rows = b.low.shape
    scale, path = np.ones((rows, n)), np.ones(n, bool)
    start = np.where(b.valid[0, : b.row_width[0]], 1 / b.width[:, 0], 0)
    fm, fi, fd = [start], [np.zeros_like(start)], [np.zeros_like(start)]
    emits, shares = [start], [start]  # the first row has no base
    for i in range(1, rows):
        live, w = i <= b.n_bases, b.row_width[i]
        ok, (emit, share) = b.valid[i, :w], b.emission(i)
        emits.append(emit), shares.append(share)
        # One shift serves the three states, as it is linear.
        m = emit * b.shifted(mm * fm[-1] + im * fi[-1] + dm * fd[-1], i - 1, i, -1)
        ins = b.shifted((0.25 * mi) * fm[-1] + (0.25 * ii) * fi[-1], i - 1, i, 0)
        if not (even := ok.all()):
            m *= ok
            ins *= ok
        gap = np.zeros((w, n))
        open_ = i < b.n_bases
        total = m[0] + ins[0]
        for c in range(1, w):
            gap[c] = (md * m[c - 1] + dd * gap[c - 1]) * (open_ if even else ok[c] & open_)
            total = total + (m[c] + ins[c] + gap[c])  # in one order, however wide the batch
        if (total < 0).any() or not np.isfinite(total).all():
            raise ArithmeticError("the model is unsound on a read")
        path &= ~live | (total >= np.finfo(float).tiny)
        inverse = np.where(live & path, 1 / np.where(total > 0, total, 1), 0.0)
        scale[i] = inverse
        fm.append(m * inverse), fi.append(ins * inverse), fd.append(gap * inverse)
    out = np.zeros((3, b.window + len(b.cells), n))
    bm = bi = None
    for i in range(rows - 1, -1, -1):
        w = b.row_width[i]
        ending, inner, ok = i == b.n_bases, i < b.n_bases, b.valid[i, :w]
        if i + 1 < rows:
            s = scale[i + 1]
            p = b.shifted(emits[i + 1] * bm, i + 1, i, 1) * s
            q = b.shifted(bi, i + 1, i, 0) * (0.25 * s)
        else:
            p = q = np.zeros((w, n))
        even, going = ok.all(), inner.all()
        gap = np.zeros((w + 1, n))
        if i:
            for c in range(w - 1, -1, -1):
                gap[c] = dm * p[c] + dd * gap[c + 1]
                if not even:
                    gap[c] *= ok[c]
        bm, new_bi = mm * p + mi * q + md * gap[1:], im * p + ii * q
        if not going:
            bm, new_bi = (np.where(ending, 1.0, np.where(inner, x, 0.0)) for x in (bm, new_bi))
        if not even:
            bm *= ok
            new_bi *= ok
        if i:
            made = np.empty((3, w, n))
            np.multiply(fm[i], bm, out=made[0])
            skip, closed = fd[i] * gap[:-1], fd[i] * p
            if not going:
                made[0] *= i <= b.n_bases
                skip *= inner
                closed *= inner
            made[1] = made[0] + skip
            made[2] = made[0] * shares[i] * model.substitution_weight + (model.deletion_weight * dm) * closed
            b.add(out, made, i)
            if model.insertion_weight:
                opened = (model.insertion_weight * mi * 0.25) * scale[i] * b.shifted(fm[i - 1], i - 1, i, 0) * new_bi * (ok & (i <= b.n_bases))
                b.add(out[1:, 1:], np.stack([opened, opened]), i)
        bi = new_bi
    whole = np.zeros(n)
    for c in range(len(bm)):
        whole += fm[0][c] * bm[c]
    path &= np.isfinite(whole)
    if (np.abs(whole[path] - 1) > TOLERANCE).any():
        raise ArithmeticError("the model is unsound on a read")
    return out[:, : b.window].transpose(0, 2, 1), path


class Squares:
    """Sums of pairs of positions, in squares of bounded size."""

    def __init__(self):
        self.sums: dict[tuple[int, int, int], np.ndarray] = {}

    def add(self, tid: int, at: np.ndarray, windows: np.ndarray, inside: np.ndarray) -> None:
        """Reads of one reference: positions ``at`` of their windows (3, reads, positions), where ``inside``."""
        row, col = np.nonzero(inside)
        pos, values = at[row, col], windows[:, row, col]
        tile, dense = pos // SQUARE, {}
        for t in np.unique(tile):
            own = tile == t
            who, back = np.unique(row[own], return_inverse=True)
            part = np.zeros((3, len(who), SQUARE))
            part[:, back, pos[own] - t * SQUARE] = values[:, own]
            dense[int(t)] = who, part
        for a in dense:
            for b in dense:
                if a <= b:
                    both, left, right = np.intersect1d(dense[a][0], dense[b][0], assume_unique=True, return_indices=True)
                    if len(both):
                        (c, s, m), (d, t, u) = dense[a][1][:, left], dense[b][1][:, right]
                        self.sums[tid, a, b] = self.sums.get((tid, a, b), 0) + np.stack([s.T @ t, m.T @ t, s.T @ u, m.T @ u, c.T @ d])

    def taken(self) -> Iterator[pa.RecordBatch]:
        for (tid, a, b), found in self.sums.items():
            i, j = np.nonzero(np.triu(found[0] > 0) if a == b else found[0] > 0)
            if len(i):
                yield _rows("pair", tid, i + a * SQUARE, j + b * SQUARE, *found[:, i, j])
        self.sums = {}


_OUT = "kind string, tid int, i int, j int, a double, b double, c double, d double, e double"
_COLUMNS = [x.split()[0] for x in _OUT.split(", ")]


def _rows(kind: str, tid, i, j, *values) -> pa.RecordBatch:
    n = len(np.atleast_1d(i))
    whole = lambda x, t: pa.array(np.broadcast_to(np.asarray(x, t), n))
    return pa.RecordBatch.from_arrays([pa.array([kind] * n), whole(tid, np.int32), whole(i, np.int32), whole(j, np.int32), *(whole(v, np.float64) for v in values)], names=_COLUMNS)


def counts(reads: DataFrame, references: DataFrame, band: int = 2, model: Model | None = None, min_phred: int = 0, pairs: bool = False, bands: str | None = None) -> DataFrame:
    """What accepted reads contribute, summed by task: rows of ``kind`` ``pos`` (tid, position i: coverage, span, mutations, in two rows that add up exactly), ``read`` (tid: reads with a path, and without) and, if asked, ``pair`` (tid, positions i <= j: five sums).

    Only the stretch of the reference that a read's band can touch goes to the task with it. ``bands`` names a column of arrays with
    a half-width for each row of the band, one before the first placed base and one after each, in place of ``band``.
    """
    model = model or Model()
    half = F.lit(band) if bands is None else F.array_max("band")
    lens = F.transform(F.regexp_extract_all("cigar", F.lit("([0-9]+)[MIDNSHP=X]"), F.lit(1)), lambda x: x.cast("int"))
    kinds = F.regexp_replace("cigar", "[^MIDNSHP=X]", "")
    needed = reads.select("tid", "pos", "cigar", "seq", "qual", *([F.col(bands).alias("band")] if bands else []))
    sent = with_stretch(needed, references, F.col("pos") - (half + 1), reference_span(F.col("cigar")) + 2 * half + 4)
    sent = sent.select("tid", "pos", kinds.alias("kinds"), lens.alias("lens"), ascii_only(F.col("seq"), "N").alias("seq"), ascii_only(F.col("qual"), "?").alias("qual"), "stretch", "stretch_from", "ref_len", *(["band"] if bands else []))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares = Squares()
        for arrow in batches:
            if not arrow.num_rows:
                continue
            all_reads = Reads(arrow)
            keys, values, paths = [], [], np.zeros(all_reads.n, bool)
            for chosen in all_reads.batches(0 if bands else band):
                batch = Batch(all_reads, chosen, 0 if bands else band, min_phred, model.modification)
                windows, paths[chosen] = posteriors(batch, model)
                at = batch.origin[:, None] + np.arange(batch.window)
                inside = paths[chosen][:, None] & (at >= 0) & (at < batch.ref_len[:, None]) & (windows[1] > 0)
                tids = all_reads.tid[chosen]
                # Sums of a batch at once: few positions come again and again.
                row, col = np.nonzero(inside)
                found_tid, found_at, found = by_position(tids[row], at[row, col], [v[row, col] for v in windows])
                keys.append(found_tid << 40 | found_at), values.append(np.stack(found))
                if pairs:
                    for tid in np.unique(tids):
                        mine = tids == tid
                        squares.add(int(tid), at[mine], windows[:, mine], inside[mine])
                        if len(squares.sums) > SQUARES:
                            yield from squares.taken()
            key, back = np.unique(np.concatenate(keys), return_inverse=True)
            total = [np.bincount(back, x, len(key)) for x in np.concatenate(values, axis=1)]
            for half in (0, 1):
                yield _rows("pos", key >> 40, key & ((1 << 40) - 1), 0, *total[half::2], 0.0, 0.0)
            tids, back = np.unique(all_reads.tid, return_inverse=True)
            good = np.bincount(back, paths, len(tids))
            yield _rows("read", tids, np.zeros(len(tids)), 0, good, np.bincount(back, minlength=len(tids)) - good, 0.0, 0.0, 0.0)
        yield from squares.taken()

    return sent.mapInArrow(counted, _OUT)
