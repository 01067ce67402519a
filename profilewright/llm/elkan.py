"""Centroid clustering of integer vectors with Elkan's bounds: exact, round by round.

Each vector carries an upper bound of the distance to its centroid and a lower bound for every centroid. Centroids that move loosen
the bounds by as much; half the distances between centroids, and the bounds, tell which distances need no computing. Bounds are
kept as 32-bit floats that are rounded away from the truth, and only strictly worse centroids are skipped, so that ties still go to
the smaller number. Every distance that is computed is an exact integer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize
from .common import private, table

K, ROUNDS, DIMS, SCALE, SEED = 16, 3, 64, 64, 1
#: Components of the integer vectors may be this large; with 64 of them, a squared distance still fits a long.
LARGEST = 1 << 27
#: Room for the rounding of a few operations on doubles.
_ROOM = 2.0**-50


def finite_vectors(vector: Column) -> Column:
    """A vector that is there, and has neither null nor NaN nor infinite components."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def whole(vector: Column, scale: int, offset: int, largest: int) -> Column:
    """``floor(scale * x) + offset`` of each component as a long; beyond ``largest`` the row can't be reckoned exactly, and is refused."""
    floor = lambda x: F.floor(x.cast("double") * scale)
    return F.transform(vector, lambda x: F.when(F.abs(floor(x)) <= largest, floor(x) + offset).otherwise(F.raise_error(F.lit(f"a component is larger than {largest} / {scale}"))))


def above(x: np.ndarray) -> np.ndarray:
    """32-bit floats not below ``x``, which may be off by a few roundings."""
    x = x * (1 + _ROOM)
    out = x.astype(np.float32)
    return np.where(out < x, np.nextafter(out, np.float32(np.inf)), out)


def below(x: np.ndarray) -> np.ndarray:
    """32-bit floats not above ``x``, and not below 0."""
    x = np.maximum(x, 0) * (1 - _ROOM)
    out = x.astype(np.float32)
    return np.where(out > x, np.nextafter(out, np.float32(-np.inf)), out)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to rows, or of rows to one."""
    return ((x - c) ** 2).sum(axis=-1)


def first_distances(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid, upper and lower bounds, from all distances."""
    found = np.stack([squared(x, c) for c in centroids], axis=1)
    near = found.argmin(axis=1)
    return near, above(np.sqrt(found[np.arange(len(x)), near])), below(np.sqrt(found))


def closer(x: np.ndarray, near: np.ndarray, upper: np.ndarray, lower: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroids and bounds after the centroids moved, from those before; and how many distances each vector needed."""
    k = len(centroids)
    moved = above(np.sqrt(squared(before, centroids))).astype(float)
    half = below(np.sqrt([squared(centroids, c) for c in centroids]) / 2).astype(float)
    half[np.arange(k), np.arange(k)] = np.inf
    near = near.copy()
    upper = above(upper.astype(float) + moved[near]).astype(float)
    lower = below(lower.astype(float) - moved).astype(float)
    computed = np.zeros(len(x), np.int64)
    open_ = lambda r, j: (near[r] != j) & (upper[r] >= lower[r, j]) & (upper[r] >= half[near[r], j])
    rows = np.flatnonzero(upper >= half.min(axis=1)[near])
    rows = rows[np.any([open_(rows, j) for j in range(k)], axis=0)]
    best = np.zeros(len(x), np.int64)  # exact, for the rows left
    best[rows] = squared(x[rows], centroids[near[rows]])
    upper[rows], lower[rows, near[rows]] = above(np.sqrt(best[rows])), below(np.sqrt(best[rows]))
    computed[rows] += 1
    for j in range(k):
        r = rows[open_(rows, j)]
        found = squared(x[r], centroids[j])
        lower[r, j] = below(np.sqrt(found))
        computed[r] += 1
        wins = (found < best[r]) | ((found == best[r]) & (j < near[r]))
        r, found = r[wins], found[wins]
        near[r], best[r], upper[r] = j, found, above(np.sqrt(found))
    return near, upper.astype(np.float32), lower.astype(np.float32), computed


def matrix(column: pa.ListArray, kind=np.int64) -> np.ndarray:
    """A column of lists of one length, none null, as a matrix."""
    return np.asarray(column.flatten()).astype(kind).reshape(len(column), -1)


def lists_of(values: np.ndarray) -> pa.Array:
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(values.ravel()))


def assignment(before: np.ndarray | None, centroids: np.ndarray, last: bool) -> Callable:
    """Batches of vectors, with bounds unless ``before`` is None, to the same with new bounds; the last ones to ``kept, cluster, distance, computed``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("x"))
            if before is None:
                near, upper, lower = first_distances(x, centroids)
                computed = np.full(len(x), len(centroids))
            else:
                near, upper, lower, computed = closer(x, np.asarray(batch.column("cluster")), np.asarray(batch.column("upper")), matrix(batch.column("lower"), np.float32), before, centroids)
                computed = computed + np.asarray(batch.column("computed"))
            own = [batch.column("kept")] if last else [batch.column("kept"), batch.column("x")]
            made = [pa.array(squared(x, centroids[near]))] if last else [pa.array(upper), lists_of(lower)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(near.astype(np.int32)), *made, pa.array(computed.astype(np.int64))], names=[*(["kept"] if last else ["kept", "x"]), "cluster", *(["distance"] if last else ["upper", "lower"]), "computed"])

    return rows


def cluster_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches ``cluster, x`` to ``cluster, n, total``: a row for each cluster of a task."""
    n, total = {}, {}
    for batch in batches:
        if batch.num_rows:
            near, x = np.asarray(batch.column("cluster")), matrix(batch.column("x"))
            for j in np.unique(near).tolist():
                mine = near == j
                n[j] = n.get(j, 0) + int(mine.sum())
                total[j] = total.get(j, 0) + x[mine].sum(axis=0)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int32()), pa.array(list(n.values()), pa.int64()), lists_of(np.stack(list(total.values())))], names=["cluster", "n", "total"])


def moved_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Exact floors of the means; a centroid without vectors stays."""
    parts = state.select("cluster", "x").mapInArrow(cluster_sums, "cluster int, n long, total array<long>")
    sums = parts.select("cluster", "n", F.posexplode("total").alias("dim", "part")).groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    out = centroids.copy()
    for r in sums.collect():  # k rows a dimension
        out[r["cluster"], r["dim"]] = int(r["total"]) // r["n"]
    return out


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``vectors`` without ``vector``, and ``cluster, distance, cluster_inertia, inertia, centroid_sha256, computed``, which take the place of columns of those names.

    Rows whose vector is null, of another length than ``dims``, or with a null or non-finite component are left out. Components
    become ``floor(scale * x)``; larger ones than 2**27 are refused. The first centroids are the ``k`` vectors with the smallest
    sha256 of ``seed:key``; of one key, the smallest vector first; a null key comes last. With fewer vectors there are fewer
    centroids, and without any no row. Repeated rows count each, and get a row each. ``computed`` is the number of distances that
    the bounds left to be computed, of ``(rounds + 1) * k``.
    """
    spark, names = vectors.sparkSession, ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "computed")
    rest = [c for c in vectors.columns if c.lower() not in (vector.lower(), *names)]
    v = F.col(f"`{vector}`")
    usable = vectors.filter((F.size(v) == dims) & finite_vectors(v))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(f"`{key}`").cast("string")), 256)
    held = usable.select(F.struct(*(F.col(f"`{c}`") for c in rest), F.lit(1).alias(private(vectors, "one"))).alias("kept"), whole(v, scale, 0, LARGEST).cast("array<int>").alias("x"), order.alias("order"))
    first = [r["x"] for r in held.orderBy(F.col("order").asc_nulls_last(), "x").select("x").limit(k).collect()]
    kind = held.schema["kept"].dataType.simpleString()
    state, before, now = held.select("kept", "x"), None, np.array(first, np.int64).reshape(len(first), dims)
    for _ in range(rounds if first else 0):
        state = materialize(state.mapInArrow(assignment(before, now, False), f"kept {kind}, x array<int>, cluster int, upper float, lower array<float>, computed long"), "elkan")
        before, now = now, moved_centroids(state, now)
    final_schema = f"kept {kind}, cluster int, distance long, computed long"
    final = materialize(state.mapInArrow(assignment(before, now, True), final_schema), "elkan-final") if first else spark.createDataFrame([], final_schema)
    inertia = {r["cluster"]: r["s"] for r in final.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now.tolist()]
    totals = spark.createDataFrame([(j, inertia.get(j, 0), sum(inertia.values()), d) for j, d in enumerate(digests)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = final.join(F.broadcast(totals), "cluster")
    return joined.select(*(F.col("kept").getField(c).alias(c) for c in rest), *names)


def op12_elkan_clusters(spark, sf_dir):
    return cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).drop("computed")


def _round(i: int) -> str:
    """SQL of one assignment to the centroids ``c{i}``, and of the centroids after it."""
    return f"""
dd{i} AS (SELECT v.row_id, c.j, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{i} c ON v.dim = c.dim GROUP BY v.row_id, c.j),
a{i} AS (SELECT row_id, j, d FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d, j) AS rn FROM dd{i}) WHERE rn = 1),
m{i} AS (SELECT a.j, v.dim, CAST(floor(sum(v.x) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS x FROM a{i} a JOIN v USING (row_id) GROUP BY a.j, v.dim),
c{i + 1} AS (SELECT c.j, c.dim, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m ON c.j = m.j AND c.dim = m.dim)"""


OP12_SQL = f"""
WITH rows AS (SELECT row_number() OVER (ORDER BY vec_id) AS row_id, vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x))) = 64),
v AS (SELECT row_id, vec_id, dim, CAST(floor(64 * CAST(embedding[dim] AS DOUBLE)) AS BIGINT) AS x FROM rows, unnest(range(1, 65)) AS t(dim)),
first AS (SELECT row_id, row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR))) - 1 AS j FROM rows),
c0 AS (SELECT CAST(j AS INT) AS j, dim, x FROM first JOIN v USING (row_id) WHERE j < 16),
{",".join(_round(i) for i in range(4))},
digest AS (SELECT j, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY dim)) AS centroid_sha256 FROM c3 GROUP BY j)
SELECT vec_id, CAST(j AS INT) AS "cluster", CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a3 JOIN rows USING (row_id) JOIN digest USING (j)
"""
