"""Deterministic synthetic references and reads: every reference is made from its own seeds, so any subset can be made alone."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..schema import ALIGNMENTS, REFERENCES


def draw(spec: str | int | float, rng: np.random.Generator) -> int:
    """A value of ``40``, of the range ``20:200``, or of the list ``0,1,30`` (64 values at most)."""
    text = str(spec)
    if ":" in text:
        low, high = (int(x) for x in text.split(":"))
        if high < low:
            raise ValueError(f"an empty range: {text}")
        return int(rng.integers(low, high + 1))
    values = [int(float(x)) for x in text.split(",")]
    if len(values) > 64:
        raise ValueError("a list has 64 values at most")
    return values[int(rng.integers(len(values)))] if len(values) > 1 else values[0]


@dataclass(frozen=True)
class Options:
    references: int = 100
    length: str = "400"
    covered: float = 1.0
    reads: str = "20"
    span: str = "100:400"
    mapq: str = "0,1,10,30,42,60"
    quality: str = "30:40"
    reverse: float = 0.5
    unmapped: int = 10
    mismatch: float = 0.01
    insertions: str = "0:1"
    insertion_length: str = "1:5"
    deletions: str = "0:1"
    deletion_length: str = "1:3"
    clips: str = "0:2"
    clip_length: str = "5:30"
    seed: int = 1


def _rng(seed: int, tid: int, purpose: int) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64(np.random.SeedSequence([seed, tid, purpose])))


def _bases(rng: np.random.Generator, n: int) -> str:
    return "".join("ACGT"[i] for i in rng.integers(0, 4, n))


def reference(o: Options, tid: int) -> str:
    return _bases(_rng(o.seed, tid, 1), max(1, draw(o.length, _rng(o.seed, tid, 0))))


def one_read(o: Options, rng: np.random.Generator, ref: str, start: int, span: int) -> tuple[str, str, str]:
    """CIGAR, bases and qualities of a read of ``span`` reference bases, its events kept off both ends."""
    gaps = {}
    for _ in range(draw(o.deletions, rng)):
        n = draw(o.deletion_length, rng)
        if span > n + 2:
            gaps.setdefault(int(rng.integers(1, span - n)), ("D", n))
    for _ in range(draw(o.insertions, rng)):
        if span > 2:
            gaps.setdefault(int(rng.integers(1, span)), ("I", draw(o.insertion_length, rng)))
    ops, seq, at = [], [], 0

    def add(op: str, n: int) -> None:
        if n > 0:
            ops.append([op, n]) if not ops or ops[-1][0] != op else ops.__setitem__(-1, [op, ops[-1][1] + n])

    for place in [*sorted(gaps), span]:
        if place < at:
            continue
        part = list(ref[start + at : start + place])
        for k in np.flatnonzero(rng.random(len(part)) < o.mismatch):
            part[k] = "ACGT".replace(part[k], "")[int(rng.integers(3))]
        add("M", len(part))
        seq += part
        at = place
        if place in gaps:
            op, n = gaps[place]
            add(op, n)
            if op == "D":
                at += n
            else:
                seq += _bases(rng, n)
    n_clips = draw(o.clips, rng)
    for end in range(n_clips):
        n = draw(o.clip_length, rng)
        ops.insert(0, ["S", n]) if end == 0 else ops.append(["S", n])
        seq = list(_bases(rng, n)) + seq if end == 0 else seq + list(_bases(rng, n))
    qual = "".join(chr(33 + draw(o.quality, rng)) for _ in seq)
    return "".join(f"{n}{op}" for op, n in ops), "".join(seq), qual


def generate(spark: SparkSession, options: Options | None = None, tasks: int = 8) -> tuple[DataFrame, DataFrame]:
    """``references`` and ``alignments``; the same options give the same rows, however they are dealt out."""
    o = options or Options()
    ids = spark.range(0, o.references, 1, tasks)

    def made_references(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(int(t), f"ref{t:06d}", None, seq, len(seq)) for t in frame["id"] for seq in [reference(o, int(t))]]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in REFERENCES.split(", ")])

    def made_reads(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for tid in map(int, frame["id"]):
                rng, ref, rows = _rng(o.seed, tid, 2), reference(o, tid), []
                n_reads = draw(o.reads, rng) if rng.random() < o.covered else 0
                spans = sorted((int(rng.integers(0, len(ref) - s + 1)), s) for s in (min(len(ref), max(1, draw(o.span, rng))) for _ in range(n_reads)))
                for k, (start, span) in enumerate(spans):
                    cigar, seq, qual = one_read(o, rng, ref, start, span)
                    rows.append((0, tid << 32 | k, tid, start, 16 if rng.random() < o.reverse else 0, draw(o.mapq, rng), cigar, seq, qual, len(seq)))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in ALIGNMENTS.split(", ")])

    def made_unmapped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k in map(int, frame["id"]):
                seq = _bases(_rng(o.seed, k, 3), 50)
                rows.append((0, (1 << 62) + k, -1, -1, 4, 0, "*", seq, "I" * 50, 50))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ALIGNMENTS.split(", ")])

    reads = ids.mapInPandas(made_reads, ALIGNMENTS).unionByName(spark.range(0, o.unmapped, 1, 1).mapInPandas(made_unmapped, ALIGNMENTS))
    return ids.mapInPandas(made_references, REFERENCES), reads
