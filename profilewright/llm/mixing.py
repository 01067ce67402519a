"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions only.

Each source has a budget of words (its target) and a weight schedule over training time 0..1. Documents of a source stand in a
fixed shuffled order, repeated as epochs; the source's stream of words is cut off at its target. Integrating the schedule gives
the share of the budget due by a time; inverting it at the words before a copy of a document gives that copy's training position.

The running totals behind this are taken in two levels - inside hash buckets of a source, then over a source's buckets - so a
source that holds a third of all rows is spread over all tasks, and no window sees more than one bucket or one row a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize
from .common import n_words

REPEATS = 3
BUCKET_DIGITS = 3


def shuffle_key(doc_id: Column, text: Column) -> Column:
    """A fixed pseudo-random order of documents; equal rows alone can tie, and they are interchangeable."""
    return F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))


def source_targets(sizes: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """``name, source, source_size`` to ``name, source, source_size, place, weight, target``.

    Sources by code point, null last, weigh 1, 2, 3, repeating, and share the sum of all sizes; a target stops at ``repeats``
    times the source's size and the excess goes to the others by weight until none is above. In closed form: order the sources
    by size over weight; those are capped, from the front on, whose cap is under their share of what the earlier ones leave.
    Works on one row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("place", F.row_number().over(by_name)).withColumn("weight", (F.col("place") - 1) % 3 + 1)
    tightest = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    before = tightest.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total, cap = F.sum("source_size").over(everyone), F.lit(repeats) * F.col("source_size")
    left = total - F.coalesce(F.sum(cap).over(before), F.lit(0))
    weight_left = F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    capped = weighed.withColumns({"left": left, "weight_left": weight_left}).withColumn("is_capped", cap * F.col("weight_left") <= F.col("left") * F.col("weight"))
    # Once a source is uncapped, so are all after it, at the level that the first of them meets.
    level = F.min(F.when(~F.col("is_capped"), F.struct(F.col("source_size") / F.col("weight"), "place", "left", "weight_left"))).over(everyone)
    return capped.withColumn("level", level).select(
        "name", "source", "source_size", "place", "weight",
        F.when(F.col("is_capped"), cap.cast("double")).otherwise(F.col("weight") * F.col("level.left").cast("double") / F.col("level.weight_left")).alias("target"),
    )


def slope_of(place: Column) -> Column:
    """The default schedules: by turns rising, level and falling straight lines, 1 + slope * (2t - 1) at time t; slope within -1..1."""
    return F.element_at(F.array(F.lit(0.5), F.lit(0.0), F.lit(-0.5)), ((place - 1) % 3 + 1).cast("int"))


def time_of(share: Column, slope: Column) -> Column:
    """Inverse of the integral ``slope * t**2 + (1 - slope) * t`` of a straight schedule."""
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share)
    return F.when((slope == 0) | (share == 0), share).otherwise((root - (1 - slope)) / (2 * F.when(slope == 0, 1.0).otherwise(slope)))


def mix(docs: DataFrame, repeats: int = REPEATS, bucket_digits: int = BUCKET_DIGITS, slope=slope_of, keep: tuple[str, ...] = ()) -> DataFrame:
    """Deal out ``docs(doc_id, text, source)``; of other columns, those in ``keep`` are passed on.

    One row a document: ``doc_id, source, size, source_size, target, taken, n_copies, position, positions``. ``taken`` counts the words the mix takes
    of it, repeats included: the source's stream of documents, epoch after epoch, is cut at its rounded target, so a source's
    taken words sum to that exactly and no document is above ``repeats`` times its size. ``positions`` are the training times
    (0..1) of its copies, ascending, ``n_copies`` of them; ``position`` is the first, null if none is taken.
    Null text, or one of blanks: size 0, nothing taken. Null source: a source of its own, last. Equal rows get a row each. Empty
    input: no rows. Every step is deterministic, so reruns agree.
    """
    def sizes(*more: str) -> DataFrame:
        own = docs.select("doc_id", F.col("source").alias("source"), n_words(F.col("text")).alias("size"), shuffle_key(F.col("doc_id"), F.col("text")).alias("key"), *more)
        # A name that is never null, so that windows and joins by source share one exchange.
        name = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("+"), F.col("source")))
        return own.withColumns({"bucket": F.substring("key", 1, bucket_digits), "name": name})

    sized = materialize(sizes(), "mix-sizes")
    buckets = sized.groupBy("name", "bucket").agg(F.sum("size").alias("bucket_size"), F.first("source").alias("source"))
    targets = source_targets(buckets.groupBy("name").agg(F.sum("bucket_size").alias("source_size"), F.first("source").alias("source")), repeats)
    earlier = Window.partitionBy("name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # At most 16 ** bucket_digits rows a source, however large it is.
    offsets = buckets.select("name", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("before")).join(targets.drop("source"), "name")
    inside = Window.partitionBy("name", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    # What is passed on is read again rather than written twice.
    rows = sizes(*keep) if keep else sized
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["name", "bucket"])
    start, goal = F.col("before") + F.col("inside"), F.least(F.round("target").cast("long"), F.lit(repeats) * F.col("source_size"))
    epochs = F.when(F.col("source_size") > 0, F.floor(goal / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0).cast("long")
    rest = goal - epochs * F.col("source_size")
    partial = F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    n_copies = (F.when(F.col("size") > 0, epochs).otherwise(0) + (partial > 0).cast("long")).cast("long")

    def at(epoch: int) -> Column:
        share = (start + epoch * F.col("source_size")) / F.greatest(goal, F.lit(1))
        return time_of(F.least(share, F.lit(1.0)), slope(F.col("place")))

    return placed.select(
        "doc_id", "source", "size", "source_size", "target",
        (epochs * F.col("size") + partial).cast("long").alias("taken"),
        n_copies.alias("n_copies"), F.when(n_copies > 0, at(0)).alias("position"),
        F.slice(F.array(*(at(epoch) for epoch in range(repeats))), F.lit(1), n_copies.cast("int")).alias("positions"), *keep,
    )


def copies(mixed: DataFrame) -> DataFrame:
    """A mix with a row for each copy: ``copy`` (1, 2, ...), its own ``position``, and in ``taken`` its own words; all but a source's last copy are whole."""
    each = mixed.select(*(c for c in mixed.columns if c not in ("position", "positions")), F.posexplode("positions").alias("nth", "position"))
    own = F.least(F.col("size"), F.col("taken") - F.col("nth") * F.col("size"))
    return each.withColumns({"taken": own, "copy": F.col("nth").cast("long") + 1}).drop("nth")


def in_order(mixed: DataFrame) -> DataFrame:
    """The copies of a mix, range-sorted by training position: partition by ranges of the position, then sort inside."""
    return copies(mixed).repartitionByRange("position", "doc_id", "copy").sortWithinPartitions("position", "doc_id", "copy")


def in_ranges(mixed: DataFrame) -> DataFrame:
    """Documents range-sorted by the training position of their first copy; those of which nothing is taken come last."""
    order = F.col("position").asc_nulls_last()
    return mixed.repartitionByRange(order, "doc_id").sortWithinPartitions(order, "doc_id")


def by_first_copy(mixed: DataFrame) -> DataFrame:
    """Documents of which words are taken, range-sorted by the position of their first copy; ``in_order`` of it gives all copies in training order."""
    return in_ranges(mixed.filter("taken > 0"))


def op8_mix_sources(spark, sf_dir):
    """A row a document, in the order of its first copy in training, with the positions of all its copies."""
    from .common import table

    mixed = mix(table(spark, sf_dir, "documents")).drop("source")
    later = {f"position_{k}": F.get("positions", F.lit(k - 1)) for k in range(2, REPEATS + 1)}
    return in_ranges(mixed).withColumns(later).drop("positions")


def op8_mix_copies(spark, sf_dir):
    """Every copy of every document that the mix takes, in the order of training."""
    from .common import table

    return in_order(mix(table(spark, sf_dir, "documents")))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
s1 AS (SELECT *, (place - 1) % 3 + 1 AS weight FROM s0),
s2 AS (SELECT *, (SELECT sum(source_size) FROM s1) - coalesce(sum(3 * source_size) OVER w, 0) AS rest,
              (SELECT sum(weight) FROM s1) - coalesce(sum(weight) OVER w, 0) AS weight_left
       FROM s1 WINDOW w AS (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, 3 * source_size * weight_left <= rest * weight AS is_capped FROM s2),
lev AS (SELECT rest, weight_left FROM s3 WHERE NOT is_capped ORDER BY source_size / weight, place LIMIT 1),
s AS (SELECT source, source_size, place, CASE WHEN is_capped THEN CAST(3 * source_size AS DOUBLE)
             ELSE weight * CAST((SELECT rest FROM lev) AS DOUBLE) / CAST((SELECT weight_left FROM lev) AS DOUBLE) END AS target FROM s3),
p AS (SELECT d.doc_id, d.source, d.size, s.source_size, s.target, s.place,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
             least(CAST(round(s.target) AS BIGINT), 3 * s.source_size) AS goal
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
q AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS epochs FROM p),
r AS (SELECT *, greatest(0, least(size, goal - epochs * source_size - start)) AS part, CASE (place - 1) % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE -0.5::DOUBLE END AS slope FROM q),
c AS MATERIALIZED (SELECT *, CASE WHEN size > 0 THEN epochs ELSE 0 END + CAST(part > 0 AS BIGINT) AS copies, row_number() OVER () AS row_id FROM r),
each AS (SELECT doc_id, row_id, k, least((start + (k - 1) * source_size) / greatest(goal, 1), 1.0::DOUBLE) AS share, slope FROM c, unnest(range(1, copies + 1)) AS t(k)),
due AS (SELECT row_id, k, CASE WHEN slope = 0 OR share = 0 THEN share ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * share) - (1 - slope)) / (2 * slope) END AS position FROM each),
wide AS (SELECT row_id, max(position) FILTER (k = 1) AS position, max(position) FILTER (k = 2) AS position_2, max(position) FILTER (k = 3) AS position_3 FROM due GROUP BY row_id)
SELECT doc_id, size, source_size, target, CAST(epochs * size + part AS BIGINT) AS taken, CAST(copies AS BIGINT) AS n_copies, position, position_2, position_3
FROM c LEFT JOIN wide USING (row_id)
"""

#: As above, a row for each copy.
OP8_COPIES_SQL = (
    OP8_SQL[: OP8_SQL.index("wide AS (")].rstrip().rstrip(",")
    + """
SELECT doc_id, source, size, source_size, target, CAST(copies AS BIGINT) AS n_copies, CAST(least(size, epochs * size + part - (k - 1) * size) AS BIGINT) AS taken, k AS copy, position
FROM due JOIN c USING (row_id)
"""
)
