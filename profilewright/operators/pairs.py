"""Co-mutation statistics of pairs of positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import nan

SUMS = ("span", "left", "right", "both", "covered")


def pair_sums(reads: DataFrame) -> DataFrame:
    """``tid, read, pos, coverage, spanned, mutations``, one row a read and position, to the five sums of positions i <= j that share reads.

    A read's positions are gathered once and paired where they are; its sums are partly made before they are shuffled again.
    """
    own = reads.groupBy("tid", "read").agg(F.collect_list(F.struct("pos", "coverage", "spanned", "mutations")).alias("at"))  # a read's positions
    both = own.select("tid", "at", F.explode("at").alias("x")).select("tid", "x", F.explode("at").alias("y")).filter("x.pos <= y.pos")
    products = (("spanned", "spanned"), ("mutations", "spanned"), ("spanned", "mutations"), ("mutations", "mutations"), ("coverage", "coverage"))
    sums = (F.sum(F.col(f"x.{x}") * F.col(f"y.{y}")).alias(name) for name, (x, y) in zip(SUMS, products, strict=True))
    return both.groupBy("tid", F.col("x.pos").alias("i"), F.col("y.pos").alias("j")).agg(*sums)


def correlation(min_depth: float = 1.0) -> Column:
    span, left, right, both = (F.col(c) for c in SUMS[:4])
    scale = left * (span - left) * right * (span - right)
    ok = (span > 0) & (span >= min_depth) & (scale > 0)
    return F.when(ok, (both * span - left * right) / F.sqrt(F.when(scale > 0, scale).otherwise(1.0))).otherwise(nan())


def conditional(conditioned: Column, min_depth: float = 1.0) -> Column:
    ok = (F.col("span") > 0) & (F.col("span") >= min_depth) & (conditioned > 0)
    return F.when(ok, F.col("both") / F.when(conditioned > 0, conditioned).otherwise(1.0)).otherwise(nan())


def statistics(sums: DataFrame, min_depth: float = 1.0) -> DataFrame:
    """Both orders of each pair: symmetric correlation and coverage, and the chance of a mutation at i given one at j."""
    upper = sums.select("tid", "i", "j", correlation(min_depth).alias("correlation"), conditional(F.col("right"), min_depth).alias("conditional"), F.col("covered").alias("coverage"))
    lower = sums.filter("i < j").select("tid", F.col("j").alias("i"), F.col("i").alias("j"), correlation(min_depth).alias("correlation"), conditional(F.col("left"), min_depth).alias("conditional"), F.col("covered").alias("coverage"))
    return upper.unionByName(lower).select("tid", "i", "j", *(F.col(c).cast("float").alias(c) for c in ("correlation", "conditional", "coverage")))
