"""Connected components of links between ids, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``a, b`` to ``id, component``, the smallest id reachable, for every id in a link. Hubs are met by aggregates and split joins, never by one group."""
    edges = materialize(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi > lo").distinct(), "cc")
    seen = None
    for _ in range(most_rounds):
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).filter("hi > lo").distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(lowest, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.*")
        edges = materialize(small.filter("hi > lo").distinct(), "cc")
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    roots = edges.groupBy("lo").agg(F.lit(1)).select(F.col("lo").alias("id"), F.col("lo").alias("component"))
    return edges.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(roots)
