"""Joins that no hot key holds up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pieces import is_cut
from .scratch import materialize

#: Bases a read may span to find its reference in a stretch, which has twice as many; and bases of all stretches that are broadcast at most.
STRETCH, BROADCAST_BASES = 1 << 16, 1 << 26
#: Tasks over which a stream spreads one stretch's reads, where stretches are not broadcast.
SALTS = 16
#: Rows of a task where rows are dealt by their number.
ROWS_OF_A_TASK = 1 << 20


def tasks_for(rows: DataFrame) -> int:
    """Tasks for so many rows that none has many more than ``ROWS_OF_A_TASK``, and as many as the session shuffles to at least. For tables, whose files say how many rows they have."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_OF_A_TASK))


def spread_join(large: DataFrame, small: DataFrame, on: list[str], name: str, counts: DataFrame | None = None) -> DataFrame:
    """Inner join on ``on`` where one key may hold any share of ``large``'s rows; ``small`` has few rows a key.

    Keys with more than a 1/(4 * partitions) share of the rows are 4 * partitions at most, whatever the data: their rows of
    ``small`` are broadcast, under that bound, and only the other keys are shuffled, none of which fills a task. ``counts`` has
    the keys with ``rows_of_key``, where the caller knows them.
    """
    partitions = int(large.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if counts is None:
        counts = materialize(large.groupBy(*on).agg(F.count(F.lit(1)).alias("rows_of_key")), f"{name}-counts")
    total = counts.agg(F.sum("rows_of_key")).first()[0] or 0
    hot = materialize(counts.filter(F.col("rows_of_key") > max(1000, total // (4 * partitions))).select(*on), f"{name}-hot")
    if not hot.head(1):
        return large.join(small, on)
    cold = large.join(F.broadcast(hot), on, "left_anti").join(small, on)
    return cold.unionByName(large.join(F.broadcast(small.join(F.broadcast(hot), on)), on))


def with_sums_before(rows: DataFrame, group: str, order: str, sums: list[str], name: str) -> DataFrame:
    """``rows`` with ``before_<c>``, the sum of ``c`` over the rows of the same ``group`` with a smaller ``order``, and ``all_<c>``, over all of them; an ``order`` stands once in a group.

    Running sums in two levels over a range partition by group and order, written once: a group may span any number of tasks. Each
    range sums its own rows; what earlier ranges hold of a group comes from a row a group and range.
    """
    ranged = materialize(rows.repartitionByRange(group, order).withColumn("slot", F.spark_partition_id()), name)
    by_group = Window.partitionBy(group)
    earlier = by_group.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = ranged.groupBy(group, "slot").agg(*(F.sum(c).alias(f"slot_{c}") for c in sums))
    held = {f"slots_before_{c}": F.coalesce(F.sum(f"slot_{c}").over(earlier), F.lit(0)) for c in sums} | {f"all_{c}": F.sum(f"slot_{c}").over(by_group) for c in sums}
    offsets = slots.withColumns(held).drop(*(f"slot_{c}" for c in sums))
    own = Window.partitionBy(group, "slot").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(offsets, [group, "slot"])
    made = joined.withColumns({f"before_{c}": F.col(f"slots_before_{c}") + F.coalesce(F.sum(c).over(own), F.lit(0)) for c in sums})
    return made.drop("slot", *(f"slots_before_{c}" for c in sums))


def ascii_only(text: Column, other: str) -> Column:
    """A byte for each character: ``other`` for those that ASCII lacks."""
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(F.regexp_replace(text, r"[^\x00-\x7F]", other))


def stretches(references: DataFrame, whole: bool = False) -> DataFrame:
    """``tid, ref_len, part, from_base, bases``: references cut so that a read of up to ``STRETCH`` bases lies in the row whose ``part`` its start gives. ``whole`` adds a part -1, the whole reference.

    References that come in pieces are cut at the same bases, by what each piece has of a part: a group is as long as its row.
    """
    if not is_cut(references):
        parts = F.sequence(F.lit(-1 if whole else 0).cast("bigint"), F.floor(F.greatest(F.col("len") - 1, F.lit(0)) / STRETCH))
        each = references.select("tid", F.col("len").alias("ref_len"), ascii_only(F.col("seq"), "N").cast("binary").alias("seq"), F.explode(parts).alias("part"))
        begin = F.greatest(F.col("part"), F.lit(0)) * STRETCH
        bases = F.when(F.col("part") < 0, F.col("seq")).otherwise(F.substring("seq", (begin + 1).cast("int"), F.lit(2 * STRETCH)))
        return each.select("tid", "ref_len", "part", begin.alias("from_base"), bases.alias("bases"))
    held = references.select("tid", F.col("len").alias("ref_len"), "from_base", ascii_only(F.col("bases"), "N").cast("binary").alias("bases"))
    first, last = F.floor(F.col("from_base") / STRETCH), F.floor((F.col("from_base") + F.greatest(F.length("bases") - 1, F.lit(0))) / STRETCH)
    each = held.withColumn("part", F.explode(F.sequence(F.greatest(first - 1, F.lit(0)), last)))
    skipped = F.greatest(F.col("part") * STRETCH - F.col("from_base"), F.lit(0))
    wanted = (F.col("part") + 2) * STRETCH - F.col("from_base") - skipped
    own = F.struct((F.col("from_base") + skipped).alias("at"), F.substring("bases", (skipped + 1).cast("int"), wanted.cast("int")).cast("string").alias("bases"))
    rows = each.groupBy("tid", "ref_len", "part").agg(_in_order(own).alias("bases"))
    return rows.select("tid", "ref_len", "part", (F.col("part") * STRETCH).alias("from_base"), "bases")


def _in_order(held: Column) -> Column:
    """The bases of a group's structs, put together in order of their first field."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(held)), lambda x: x["bases"]), "").cast("binary")


def intervals(wanted: DataFrame, cut: DataFrame) -> DataFrame:
    """Rows as ``stretches`` makes them, with ``last``, for the different ``tid, part, last`` of ``wanted``: the bases of all parts from one to the other, put together once however many reads want them."""
    steps = wanted.select("tid", "part", "last").distinct().withColumn("step", F.explode(F.sequence("part", "last", F.lit(2).cast("bigint"))))
    found = steps.join(cut.select("tid", F.col("part").alias("step"), "ref_len", "bases"), ["tid", "step"])
    put = found.groupBy("tid", "ref_len", "part", "last").agg(_in_order(F.struct("step", F.col("bases").cast("string").alias("bases"))).alias("bases"))
    return put.select("tid", "ref_len", "part", (F.col("part") * STRETCH).alias("from_base"), "bases", "last")


def _salted(placed: DataFrame, small: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``salt``: a key that more than a 1/(4 * partitions) share of the reads have is spread over as many tasks as it has such shares, and its row copied as often; other keys have one. There are fewer copies than 8 * partitions, whatever the data."""
    partitions = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = materialize(placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "reads-of-stretches")
    share = max(1000, (counts.agg(F.sum("n")).first()[0] or 0) // (4 * partitions))
    hot = F.broadcast(counts.filter(F.col("n") > share).select(*keys, F.ceil(F.col("n") / share).cast("int").alias("salts")))
    salts = F.coalesce("salts", F.lit(1))
    reads = placed.join(hot, keys, "left").withColumn("salt", F.pmod(F.xxhash64("seq", "cigar", "pos"), salts).cast("int")).drop("salts")
    return reads, small.join(hot, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")


def with_stretch(reads: DataFrame, references: DataFrame, start: Column, n: Column) -> DataFrame:
    """``reads`` with ``stretch``, the ``n`` bases of their reference from ``start`` on as far as it goes, ``stretch_from`` (``start``, 0 at least) and ``ref_len``. Where there are none, the stretch is empty and the length 0.

    A read of up to ``STRETCH`` bases is sent one stretch; for a longer one the stretches between its ends are put together. Stretches are
    broadcast after a check of their size. Else they are shuffled, and those of many reads go to several tasks, so that neither a
    long reference nor a deep one fills a task. Streams can't be looked at twice: their longer reads get the whole reference.
    """
    whole = reads.isStreaming
    if whole and is_cut(references):
        raise ValueError("a stream takes references whole, not in pieces")
    cut = stretches(references, whole)
    if is_cut(references):
        cut = materialize(cut, "stretches")
    bases, longest = (x or 0 for x in cut.agg(F.sum(F.length("bases")), F.max("ref_len")).first())
    placed = reads.withColumns({"stretch_from": F.greatest(start, F.lit(0)).cast("bigint"), "stretch_n": F.greatest(n, F.lit(1)).cast("int")})
    none, is_long = F.lit(-1).cast("bigint"), F.col("stretch_n") > STRETCH
    part, last, keys = F.floor(F.col("stretch_from") / STRETCH), none, ["tid", "part", "last"]
    small = cut.withColumn("last", none)
    if whole:
        part = F.when(is_long, none).otherwise(part)
    elif longest > STRETCH:  # else the first stretch is all of any reference
        last = F.when(is_long, F.floor((F.col("stretch_from") + F.col("stretch_n") - 1) / STRETCH)).otherwise(none)
        found = materialize(intervals(placed.filter(is_long).select("tid", part.alias("part"), last.alias("last")), cut), "intervals")
        small, bases = small.unionByName(found), bases + (found.agg(F.sum(F.length("bases"))).first()[0] or 0)
    placed = placed.withColumns({"part": part, "last": last})
    if bases <= BROADCAST_BASES:
        joined = placed.join(F.broadcast(small), keys, "left")
    elif whole:
        salted = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = placed.withColumn("salt", F.pmod(F.xxhash64("seq", "cigar", "pos"), F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt"], "left").drop("salt")
    else:
        salted_reads, salted = _salted(placed, small, keys)
        joined = salted_reads.join(salted, [*keys, "salt"], "left").drop("salt")
    bases_of = F.substring("bases", (F.col("stretch_from") - F.col("from_base") + 1).cast("int"), F.col("stretch_n")).cast("string")
    return joined.withColumns({"stretch": F.coalesce(bases_of, F.lit("")), "ref_len": F.coalesce("ref_len", F.lit(0))}).drop("part", "last", "from_base", "bases", "stretch_n")
