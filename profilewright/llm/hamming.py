"""Exact top-k search among binary codes, by incremental multi-index hashing.

Codes are cut into segments of about log2(n) bits, n being the codes of a chunk, so that a lookup returns about one code. Two codes
within distance d agree on some segment up to floor(d / segments) bits, so when all segment values within radius r of the query's
have been looked up, every code nearer than segments * (r + 1) has been seen. Radii grow until the k-th verified distance is under
that bound. The first radii are looked up in all chunks and their best brought together; only queries whose k-th distance in the
whole table is not covered yet go on, with that distance as a limit in every chunk, which falls further as nearer codes turn up.

A stated set of queries meets all rows in blocks: a task indexes one chunk of codes once and looks up one block of queries in it.
Queries, codes and answers stay in tables; the driver sees only how many there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize
from .common import spread_join, table

K = 10
#: The last radius that is looked up before the chunks' answers meet.
FIRST_RADIUS = 1
#: Bits of a segment at least and at most, whatever the number of codes.
LEAST_BITS, MOST_BITS = 4, 20
#: Bounds of what is held at once: distinct queries of a block, codes of a chunk, queries looked up together, and candidates of a lookup.
QUERY_BLOCK, CHUNK, TOGETHER, CANDIDATES = 50_000, 100_000, 512, 1 << 20
MOST_TASKS = 20_000
#: A distance that no code has.
FAR = 1 << 40
_ANSWERS = "q binary, code binary, ids array<long>, distance long"


def sign_code(vector: Column) -> Column:
    """Bits (component > 0) of a vector, eight to a byte, the first lowest; null for a null vector. A null component is 0; NaN, which Spark orders above all numbers, is 1."""

    @F.arrow_udf("binary")
    def coded(vectors: pa.Array) -> pa.Array:
        widths = np.asarray(vectors.value_lengths().fill_null(0))
        bits = ~(np.asarray(pc.fill_null(vectors.flatten().cast(pa.float64()), -1.0)) <= 0)
        ends = np.cumsum(widths)
        there = np.asarray(vectors.is_valid())
        return pa.array([np.packbits(bits[e - w : e], bitorder="little").tobytes() if ok else None for e, w, ok in zip(ends, widths, there, strict=True)], pa.binary())

    return coded(vector)


class Index:
    """Codes of one chunk and width, with a table for each segment."""

    def __init__(self, codes: list[bytes], width: int):
        bits = min(MOST_BITS, max(LEAST_BITS, round(np.log2(max(2, len(codes))))))
        self.cuts = np.linspace(0, width, max(1, round(width / bits)) + 1).astype(int)
        self.cuts = np.unique(self.cuts) if width else np.array([0, 0])
        self.segments = len(self.cuts) - 1
        values, self.words = self.cut(codes)
        self.tables = []
        for s in range(self.segments):
            order = np.argsort(values[:, s], kind="stable")
            self.tables.append((order, np.concatenate([[0], np.cumsum(np.bincount(values[:, s], minlength=1 << self.wide(s)))])))

    def wide(self, s: int) -> int:
        return int(self.cuts[s + 1] - self.cuts[s])

    def cut(self, codes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Segment values, and the codes as whole words of 64 bits."""
        data = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
        words = np.zeros((len(codes), max(8, -(-data.shape[1] // 8) * 8)), np.uint8)
        words[:, : data.shape[1]] = data
        bits = np.unpackbits(data, axis=1, bitorder="little")
        values = [bits[:, self.cuts[s] : self.cuts[s + 1]].astype(np.int64) @ (1 << np.arange(self.wide(s))) for s in range(self.segments)]
        return np.stack(values, axis=1), words.view(np.uint64)

    def within(self, queries: np.ndarray, words: np.ndarray, limits: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, code, distance) of the codes not beyond each query's limit with a segment that is ``radius`` bits off; one may come for several segments."""
        for s, (order, starts) in enumerate(self.tables):
            masks = np.array([sum(1 << i for i in c) for c in combinations(range(self.wide(s)), radius)], np.int64)
            if not len(masks):
                continue
            step = max(1, CANDIDATES // len(masks))
            for a in range(0, len(queries), step):
                values = queries[a : a + step, s, None] ^ masks[None, :]
                first, count = starts[values], starts[values + 1] - starts[values]
                ends = np.cumsum(count.sum(axis=1))
                i = 0
                while i < len(values):
                    before = ends[i - 1] if i else 0
                    j = max(i + 1, int(np.searchsorted(ends, before + CANDIDATES, side="right")))
                    n = count[i:j].ravel()
                    total = int(n.sum())
                    if total:
                        at = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[i:j].ravel(), n)
                        code, query = order[at], a + np.repeat(np.arange(i, j), ends[i:j] - np.concatenate([[before], ends[i : j - 1]]))
                        off = np.bitwise_count(self.words[code] ^ words[query]).sum(axis=1, dtype=np.int64)
                        near = off <= limits[query]
                        yield query[near], code[near], off[near]
                    i = j

    def grow(self, queries: np.ndarray, words: np.ndarray, limits: np.ndarray, k: int, ids: np.ndarray, first: int, last: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best codes of each query, by radii from ``first`` until each limit is covered, or to ``last``. Limits fall to the k-th distance found here."""
        best, limits, radius = (np.zeros(0, np.int64),) * 3, limits.copy(), first
        open_ = np.flatnonzero(limits >= self.segments * radius)
        while len(open_) and (last is None or radius <= last) and radius <= max(map(self.wide, range(self.segments))):
            for q, c, d in self.within(queries[open_], words[open_], limits[open_], radius):
                best = _best(*(np.concatenate(x) for x in zip(best, (open_[q], c, d), strict=True)), k, ids)
            full = np.bincount(best[0], minlength=len(queries)) >= k
            worst = np.zeros(len(queries), np.int64)
            np.maximum.at(worst, best[0], best[2])
            limits = np.where(full, np.minimum(limits, worst), limits)
            radius += 1
            open_ = np.flatnonzero(limits >= self.segments * radius)
        return best


def _best(q: np.ndarray, c: np.ndarray, d: np.ndarray, k: int, ids: np.ndarray):
    """The k nearest of each query, ties by id; equal (query, code) once."""
    order = np.lexsort((c, ids[c], d, q))
    q, c, d = q[order], c[order], d[order]
    fresh = np.concatenate([[True], (q[1:] != q[:-1]) | (c[1:] != c[:-1])]) if len(q) else np.zeros(0, bool)
    q, c, d = q[fresh], c[fresh], d[fresh]
    head = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    place = np.arange(len(q)) - np.repeat(head, np.diff(np.append(head, len(q))))
    return q[place < k], c[place < k], d[place < k]


def lookup(k: int, first: int, last: int | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A chunk ``width, code, ids`` (the smallest ids of each code, ascending) and a block ``q, worst`` of queries to ``q, code, ids, distance``: of what these radii reach, the k best codes a query."""

    def found(chunk: pa.Table, block: pa.Table) -> pa.Table:
        names, codes, distances = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        chunk = chunk.combine_chunks()
        if chunk.num_rows and block.num_rows:
            index, ids = Index(chunk.column("code").to_pylist(), chunk.column("width")[0].as_py()), chunk.column("ids").combine_chunks()
            least = np.asarray(ids.flatten(), np.int64)[np.concatenate([[0], np.cumsum(np.asarray(ids.value_lengths()))[:-1]])]
            asked, limits = block.column("q").to_pylist(), np.asarray(block.column("worst"), np.int64)
            for i in range(0, len(asked), TOGETHER):
                q, c, d = index.grow(*index.cut(asked[i : i + TOGETHER]), limits[i : i + TOGETHER], k, least, first, last)
                names += [asked[i + x] for x in q]
                codes.append(c), distances.append(d)
        at = pa.array(np.concatenate(codes))
        return pa.table({"width": pa.array([chunk.column("width")[0].as_py()] * len(names) if names else [], pa.int32()), "q": pa.array(names, pa.binary()), "code": chunk.column("code").take(at), "ids": chunk.column("ids").take(at), "distance": np.concatenate(distances)})

    return found


def search(codes: DataFrame, queries: DataFrame, k: int = K, query_block: int = QUERY_BLOCK, chunk: int = CHUNK) -> DataFrame:
    """``query_id, rank, id, distance``: the ``k`` codes nearest to each query, ties by id; fewer if there are fewer codes.

    ``codes(id, code)`` and ``queries(query_id, code)``, both with ``width``, the bits of a code, where codes of as many bytes can
    have different numbers of bits. A query meets all codes of its own width, its own row too. Null codes and null ids are not
    found, and null queries find nothing. Equal codes are looked up once: of each code only the k smallest ids can matter. Repeated
    ids count as often as they stand. Empty tables give no rows. Other columns are dropped.
    """
    spark, key = codes.sparkSession, ["width", "code"]
    wide = lambda df: (F.col("width").cast("int") if "width" in df.columns else F.length("code") * 8).alias("width")
    queries = queries.filter(F.col("code").isNotNull()).select("query_id", wide(queries), "code")
    ranked = Window.partitionBy(*key).orderBy("id")
    least = codes.filter(F.col("code").isNotNull() & F.col("id").isNotNull()).select("id", wide(codes), "code").withColumn("nth", F.row_number().over(ranked)).filter(F.col("nth") <= k)
    grouped = materialize(least.groupBy(*key).agg(F.array_sort(F.collect_list("id")).alias("ids")), "mih-codes")
    open_ = materialize(queries.select("width", F.col("code").alias("q")).distinct().withColumn("worst", F.lit(FAR)), "mih-open")
    chunks, n_open, answers = max(1, -(-grouped.count() // chunk)), open_.count(), "width int, " + _ANSWERS
    # Codes are few bytes and much work: at least as many tasks as cores, by smaller blocks of queries.
    blocks = max(-(-n_open // query_block), min(n_open, -(-spark.sparkContext.defaultParallelism // chunks)), 1)
    chunk_of, block_of = F.pmod(F.xxhash64("code"), F.lit(chunks)).cast("int"), F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")
    tasks, group = min(chunks * blocks, MOST_TASKS), ["width", "chunk", "block"]

    def answered(open_: DataFrame, first: int, last: int | None) -> DataFrame:
        met = grouped.withColumns({"chunk": chunk_of, "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
        asked = open_.withColumns({"block": block_of, "chunk": F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))})
        # A number of tasks that is asked for is kept, where small shuffles would be run together.
        dealt = [df.repartition(tasks, *group).groupBy(*group) for df in (met, asked)]
        return dealt[0].cogroup(dealt[1]).applyInArrow(lookup(k, first, last), answers)

    order = Window.partitionBy("width", "q").orderBy("distance", F.get("ids", F.lit(0)), "code")
    nearer = F.coalesce(F.sum(F.size("ids")).over(Window.partitionBy("width", "q").orderBy("distance").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def best_of(found: DataFrame) -> DataFrame:
        """What one segment reaches at a radius another may have reached before."""
        once = found.groupBy("width", "q", "code").agg(F.first("ids").alias("ids"), F.first("distance").alias("distance"))
        return once.withColumns({"nth": F.row_number().over(order), "nearer": nearer}).filter((F.col("nth") <= k) & (F.col("nearer") < k)).drop("nth", "nearer")

    near = materialize(best_of(answered(open_, 0, FIRST_RADIUS)), "mih-near")
    # Short of k answers, everything is still worth reporting.
    state = near.groupBy("width", "q").agg(F.sum(F.size("ids")).alias("n"), F.max("distance").alias("farthest"))
    left = open_.drop("worst").join(state, ["width", "q"], "left").select("width", "q", F.when(F.coalesce("n", F.lit(0)) >= k, F.col("farthest")).otherwise(F.lit(FAR)).alias("worst"))
    best = best_of(near.unionByName(answered(left, FIRST_RADIUS + 1, None)))
    rows = best.select("width", F.col("q").alias("code"), F.explode("ids").alias("id"), "distance")
    top = materialize(rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("distance", "id")).cast("long")).filter(F.col("rank") <= k), "mih-top")
    return spread_join(queries, top, key, "mih-asked").select("query_id", "rank", "id", "distance")


def op4_topk_search(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    codes = vectors.filter(F.col("embedding").isNotNull()).select(F.col("vec_id").alias("id"), F.size("embedding").alias("width"), sign_code(F.col("embedding")).alias("code"))
    queries = codes.filter(F.col("id") % 20 == 0).select(F.col("id").alias("query_id"), "width", "code")
    return search(codes, queries).withColumnRenamed("id", "vec_id")


OP4_SQL = r"""
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS bits FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT q.vec_id AS query_id, c.vec_id, len(list_filter(list_zip(q.bits, c.bits), lambda z: z[1] != z[2])) AS distance FROM c AS q JOIN c ON len(q.bits) = len(c.bits) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p)
SELECT query_id, rank, vec_id, CAST(distance AS BIGINT) AS distance FROM r WHERE rank <= 10
"""
