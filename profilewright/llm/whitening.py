"""Whitening of vectors by a tall-skinny QR: rows are centred with exact sums, each task factors its rows, R factors are merged as a tree, and the last one's right singular vectors whiten. No covariance is formed for the fit."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize
from .common import private, table
from .elkan import lists_of, finite_vectors, matrix, whole

SCALE, OFFSET, COMPONENTS, VECTOR = 1024, 100_000, 8, "embedding"
#: Whole components may be this large, so that they are exact as doubles.
LARGEST = 1 << 40
#: Factors that are merged together, and rows that are factored at once.
FAN, ROWS = 16, 4096
#: Spreads below this share of the largest can't be told from rounding: such components are left out.
LEAST_SPREAD = 1e-10
#: Numbers of all widths' models together, which every task gets.
MOST_NUMBERS = 1 << 22

_HALF = 30
_LONG = 1 << 63


@dataclass
class Whitening:
    """One width's fit: exact sums, and for each component its direction, spread (the root of its eigenvalue) and share of the trace."""

    n: int
    sums: list[int]
    directions: np.ndarray
    spreads: np.ndarray
    explained: np.ndarray


def scaled_deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S``, exact: longs, or Python's integers where these could overflow."""
    largest = max(map(abs, sums), default=0)
    fits = n * int(np.abs(x).max(initial=0)) + largest < _LONG
    return x * n - np.array(sums, np.int64) if fits else x.astype(object) * n - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return np.asarray(scaled_deviations(x, n, sums) / n, float)


def square_sums(u: np.ndarray) -> pa.Array:
    """Exact sums of squares of rows; null where a long can't hold one."""
    most = int(np.abs(u).max(initial=0))
    if u.shape[1] * most * most < _LONG:
        return pa.array((u.astype(np.int64) ** 2).sum(axis=1))
    return pa.array([s if (s := sum(int(a) * int(a) for a in row)) < _LONG else None for row in u.tolist()], pa.int64())


def by_width(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """The rows of each width, and their vectors as a matrix."""
    widths = np.asarray(batch.column("x").value_lengths())
    for width in np.unique(widths).tolist():
        rows = batch if (widths == width).all() else batch.filter(pa.array(widths == width))
        if width:
            yield width, rows, matrix(rows.column("x"))


def width_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches ``x`` to ``width, n, high, low``: sums of a task in two halves, which add up without loss."""
    n, total = {}, {}
    for batch in batches:
        for width, _, x in by_width(batch):
            n[width] = n.get(width, 0) + len(x)
            total[width] = total.get(width, 0) + x.sum(axis=0).astype(object)
    for width in n:
        halves = [pa.array([[int(s) >> _HALF for s in total[width]]]), pa.array([[int(s) & ((1 << _HALF) - 1) for s in total[width]]])]
        yield pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([n[width]]), *halves], names=["width", "n", "high", "low"])


def r_factor(a: np.ndarray) -> np.ndarray:
    return np.linalg.qr(a, mode="r")


def _factors(slot: int, found: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for width, r in found.items():
        yield pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([slot]), lists_of(r.reshape(1, -1))], names=["width", "slot", "r"])


def task_factors(fits: dict[int, tuple[int, list[int]]], rows_at_once: int = ROWS) -> Callable:
    """Batches ``x`` to ``width, slot, r``: the R factor of a task's centred rows, by rows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {}
        for batch in batches:
            for width, _, x in by_width(batch):
                for i in range(0, len(x), max(rows_at_once, width)):
                    part = centred(x[i : i + max(rows_at_once, width)], *fits[width])
                    found[width] = r_factor(np.vstack([found[width], part]) if width in found else part)
        yield from _factors(TaskContext.get().partitionId(), found)

    return rows


def merged(group: pa.Table) -> pa.Table:
    """One R factor for those of a group."""
    width = group.column("width")[0].as_py()
    stack = np.vstack([np.asarray(r.values).reshape(-1, width) for r in group.column("r").combine_chunks()])
    return pa.Table.from_batches(_factors(group.column("slot")[0].as_py(), {width: r_factor(stack)}))


def held_vectors(vectors: DataFrame, vector: str) -> DataFrame:
    v = F.col(f"`{vector}`")
    rest = [F.col(f"`{c}`") for c in vectors.columns if c.lower() != vector.lower()]
    kept = F.struct(*rest, F.lit(1).alias(private(vectors, "one"))).alias("kept")
    return vectors.filter(finite_vectors(v)).select(kept, whole(v, SCALE, OFFSET, LARGEST).alias("x"))


def fit(vectors: DataFrame, components: int = COMPONENTS, vector: str = VECTOR, fan: int = FAN) -> dict[int, Whitening]:
    """The whitening of every width among the vectors; rows that ``whiten`` leaves out count nowhere."""
    x = held_vectors(vectors, vector).select("x")
    parts = x.mapInArrow(width_sums, "width int, n long, high array<long>, low array<long>")
    each = parts.select("width", "n", F.posexplode(F.arrays_zip("high", "low")).alias("dim", "s"))
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    sums = materialize(each.groupBy("width", "dim").agg(F.sum("n").alias("n"), exact("s.high").alias("high"), exact("s.low").alias("low")), "whitening-sums")
    numbers = sums.count() * (components + 1)
    if numbers > MOST_NUMBERS:
        raise ValueError(f"models of {numbers} numbers for all lengths of vectors: fit them by length")
    fits = {}
    for r in sums.orderBy("width", "dim").collect():
        fits.setdefault(r["width"], (r["n"], []))[1].append((int(r["high"]) << _HALF) + int(r["low"]))
    if not fits:
        return {}
    schema = "width int, slot long, r array<double>"
    factors = materialize(x.mapInArrow(task_factors(fits), schema), "whitening-factors")
    slots = factors.agg(F.max("slot")).first()[0] + 1
    while slots > 1:
        factors, slots = factors.withColumn("slot", F.floor(F.col("slot") / fan)).groupBy("width", "slot").applyInArrow(merged, schema), -(-slots // fan)
    out = {}
    for r in factors.collect():  # one for each width
        n, total = fits[r["width"]]
        _, spread, right = np.linalg.svd(np.array(r["r"]).reshape(-1, r["width"]), full_matrices=False)
        some = min(components, int((spread > LEAST_SPREAD * spread[0]).sum()))
        directions = right[:some].T
        directions = directions * np.where(directions[np.abs(directions).argmax(axis=0), np.arange(some)] < 0, -1.0, 1.0)
        out[r["width"]] = Whitening(n, total, directions, spread[:some] / np.sqrt(n), spread[:some] ** 2 / (spread**2).sum() if some else np.zeros(0))
    return out


def projection(model: dict[int, Whitening]) -> Callable:
    """Batches ``kept, x`` to ``kept, width, deviation, whitened``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, part, x in by_width(batch):
                if (own := model.get(width)) is None or not len(own.spreads):
                    continue
                u = scaled_deviations(x, own.n, own.sums)
                z = np.asarray(u / own.n, float) @ own.directions / own.spreads
                yield pa.RecordBatch.from_arrays([part.column("kept"), pa.array(np.full(len(x), width, np.int32)), square_sums(u), lists_of(z)], names=["kept", "width", "deviation", "whitened"])

    return rows


def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches ``width, whitened`` to ``width, m, total, squares``: sums and sums of products of a task."""
    found = {}
    for batch in batches:
        widths = np.asarray(batch.column("width"))
        for width in np.unique(widths).tolist():
            z = matrix(batch.column("whitened").filter(pa.array(widths == width)), float)
            total, squares = found.get(width, (0, 0))
            found[width] = total + z.sum(axis=0), squares + z.T @ z
    for width, (total, squares) in found.items():
        yield pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), lists_of(np.concatenate([total, squares.ravel()]).reshape(1, -1))], names=["width", "sums"])


def identity_errors(projected: DataFrame, model: dict[int, Whitening]) -> dict[int, float]:
    """For each width, the largest absolute entry of the whitened vectors' covariance minus the identity."""
    parts = projected.select("width", "whitened").mapInArrow(products, "width int, sums array<double>")
    each = parts.select("width", F.posexplode("sums").alias("i", "s")).groupBy("width", "i").agg(F.sum("s").alias("s"))
    found = {}
    for r in each.orderBy("width", "i").collect():
        found.setdefault(r["width"], []).append(r["s"])
    out = {}
    for width, sums in found.items():
        own = model[width]
        some = len(own.spreads)
        mean, squares = np.array(sums[:some]) / own.n, np.array(sums[some:]).reshape(some, some) / own.n
        out[width] = float(np.abs(squares - np.outer(mean, mean) - np.eye(some)).max())
    return out


RESULTS = ("component", "n", "deviation", "whitened", "explained", "identity_error")


def whiten(vectors: DataFrame, model: dict[int, Whitening], vector: str = VECTOR) -> DataFrame:
    """``vectors`` without ``vector``, a row for each component, with ``component, n, deviation, whitened, explained, identity_error``, which take the place of columns of those names.

    Rows whose vector is null or holds null or non-finite components are left out. Components become ``floor(1024 * c) + 100000``;
    ones beyond 2**40 are refused. Vectors of another length have their own fit and ``n``. A component whose spread is nothing
    beside the first's can't be whitened and has no rows; so one vector, equal vectors and empty ones give none. Repeated rows count
    each. ``deviation`` is null where it is beyond a long, which with common embeddings begins near a million rows.
    """
    spark = vectors.sparkSession
    rest = [c for c in vectors.columns if c.lower() not in (vector.lower(), *RESULTS)]
    held = held_vectors(vectors, vector)
    projected = materialize(held.mapInArrow(projection(model), f"kept {held.schema['kept'].dataType.simpleString()}, width int, deviation long, whitened array<double>"), "whitened")
    errors = identity_errors(projected, model)
    by_component = [(w, k + 1, own.n, float(own.explained[k]), errors.get(w)) for w, own in model.items() for k in range(len(own.spreads))]
    facts = spark.createDataFrame(by_component, "width int, component int, n long, explained double, identity_error double")
    each = projected.select("kept", "width", "deviation", F.posexplode("whitened").alias("k", "whitened")).withColumn("component", F.col("k") + 1)
    return each.join(F.broadcast(facts), ["width", "component"]).select(*(F.col("kept").getField(c).alias(c) for c in rest), *RESULTS)


def op13_tsqr_whitening(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whiten(vectors, fit(vectors))
