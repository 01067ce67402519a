"""Chat formatting: logged snapshots that are prefixes of longer conversations give way to those, and what remains is rendered.

A conversation's turns, in order, get a rolling hash of the prefix that ends there. A conversation whose whole hash is a proper
prefix of another's is dropped by an anti-join, of equal ones the smallest id stays. Running values go in two levels, inside
blocks of turns and over a conversation's blocks, so an endless conversation is spread over tasks while it is hashed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize
from .common import table

#: Turn numbers of a block.
BLOCK = 256


def conversation(conv_id: Column) -> Column:
    """A name that is never null, so that windows and joins share an exchange."""
    return F.coalesce(F.concat(F.lit("+"), conv_id.cast("string")), F.lit(""))


def prefix_hashes(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """``name, conv_id, place, h1, h2, n_turns`` of each turn: its place (1, 2, ...), a 128-bit hash of the prefix that ends there, and the turns of its conversation."""
    blocked = turns.select(conversation(F.col("conv_id")).alias("name"), "conv_id", "turn", "role", "text", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / block).alias("block"))
    keys = ["name", "block"]
    earlier, whole = Window.partitionBy("name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("name")
    counts = blocked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select(*keys, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("n_turns"))
    # Equal turn numbers are ordered by role, then text, so that repeated rows are interchangeable.
    inside = Window.partitionBy(*keys).orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    placed = blocked.withColumn("in_block", F.row_number().over(inside)).join(offsets, keys).withColumn("place", F.col("before") + F.col("in_block"))
    # A turn's hash holds its place, so the xor of a prefix's turns stands for their sequence.
    own = lambda k: F.xxhash64(F.lit(f"seed {k}"), F.col("place"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text"))
    upto = Window.partitionBy(*keys).orderBy("in_block").rowsBetween(Window.unboundedPreceding, 0)
    hashed = placed.select(*keys, "conv_id", "in_block", "place", "n_turns", own(1).alias("t1"), own(2).alias("t2")).withColumns({f"x{k}": F.bit_xor(f"t{k}").over(upto) for k in (1, 2)})
    narrow = materialize(hashed.drop("t1", "t2", "in_block"), "chat-hashes")  # numbers alone; the texts are not written
    tails = narrow.groupBy(*keys).agg(F.max(F.struct("place", "x1", "x2")).alias("tail")).select(*keys, "tail.x1", "tail.x2")
    carried = tails.select(*keys, *(F.coalesce(F.bit_xor(f"x{k}").over(earlier), F.lit(0)).alias(f"c{k}") for k in (1, 2)))
    return narrow.join(carried, keys).select("name", "conv_id", "place", "n_turns", *(F.col(f"x{k}").bitwiseXOR(F.col(f"c{k}")).alias(f"h{k}") for k in (1, 2)))


def maximal(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """``conv_id, n_turns`` of conversations that are not a prefix of another; of equal ones, the smallest conv_id (null last)."""
    hashed = prefix_hashes(turns, block)
    key = ["place", "h1", "h2"]
    # Equal conversations, and the prefix that many begin with, meet partly before the shuffle; both sides of the anti-join lie by its key.
    ends = hashed.filter(F.col("place") == F.col("n_turns")).groupBy(*key).agg(F.min("conv_id").alias("conv_id"))
    prefixes = hashed.filter(F.col("place") < F.col("n_turns")).select(*key).distinct()
    return ends.join(prefixes, key, "left_anti").select("conv_id", F.col("place").alias("n_turns"))


def render(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """``conv_id, n_turns, rendered``: a row for each maximal conversation, as ``<|im_start|>role``, text, ``<|im_end|>`` lines.

    A whole conversation is one row at every length, so its text must fit in one (2 GB). Null role: ``unknown``; null text:
    empty. Turns of equal number stand in order of role, then text; repeated rows are repeated turns. A null conv_id is a
    conversation of its own. No rows for an empty table; other columns don't matter.
    """
    kept = maximal(turns, block).select(conversation(F.col("conv_id")).alias("name"), "n_turns")
    rows = turns.select(conversation(F.col("conv_id")).alias("name"), "conv_id", F.struct("turn", "role", "text").alias("t")).join(kept, "name")
    line = lambda t: F.concat(F.lit("<|im_start|>"), F.coalesce(t["role"], F.lit("unknown")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit("<|im_end|>\n"))
    whole = rows.groupBy("name").agg(F.first("conv_id").alias("conv_id"), F.first("n_turns").alias("n_turns"), F.array_sort(F.collect_list("t")).alias("turns"))
    return whole.select("conv_id", "n_turns", F.array_join(F.transform("turns", line), "").alias("rendered"))


def op1_chat_format(spark, sf_dir):
    return render(table(spark, sf_dir, "conversations")).select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "rendered")


OP1_SQL = r"""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place FROM conversations),
c AS (SELECT conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY place) AS turns FROM o GROUP BY conv_id),
p AS (SELECT DISTINCT turns[1:i] AS prefix FROM c, unnest(range(1, n)) AS t(i)),
k AS (SELECT min(conv_id) AS conv_id, n, turns FROM c WHERE turns NOT IN (SELECT prefix FROM p) GROUP BY n, turns)
SELECT o.conv_id, k.n AS n_turns, string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY place) AS rendered
FROM o JOIN k ON o.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY ALL
"""
