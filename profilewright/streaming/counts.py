"""Counting a growing folder of alignments with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators import filters
from ..operators.pileup import contributions, placed
from ..operators.profile import tangled_contributions


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """``alignments`` from Parquet files as they arrive."""
    return spark.readStream.schema(schema.ALIGNMENTS).parquet(folder)


def running_sums(alignments: DataFrame, references: DataFrame, rule: filters.ReadFilter | None = None, **options) -> DataFrame:
    """Sums by position over all that has arrived. Sums commute, so no order and no watermark is needed; the state has a row a position. Tangled reads go through the model in each micro-batch."""
    good = filters.mapped(alignments).filter(filters.accepted(rule or filters.ReadFilter()))
    each = contributions(placed(good, references), **options).unionByName(tangled_contributions(good, references, **options))
    return each.groupBy("tid", "pos").agg(*(F.sum(c).alias(c) for c in ("coverage", "spanned", "mutations")))


def running_counts(alignments: DataFrame, rule: filters.ReadFilter | None = None) -> DataFrame:
    """Counted and rejected reads by reference so far."""
    reads = filters.mapped(alignments).withColumn("ok", filters.accepted(rule or filters.ReadFilter()))
    return reads.groupBy("tid").agg(F.count_if("ok").alias("counted"), F.count_if(~F.col("ok")).alias("rejected"))
