"""References of sorted inputs given out as soon as they are finished, with Structured Streaming.

Inputs sorted by reference have passed one when they hold a later one. So a reference's number serves as event time: each input
has its own watermark, one reference behind the latest that it has shown, Spark takes the least of them, and a finished reference's
positions leave the state with the rows that are given out. Unmapped reads end an input, as they stand last in sorted files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..operators import filters
from ..operators.exact import exact_sum
from ..operators.pileup import contributions, placed
from ..operators.profile import tangled_contributions

SUMS = ("coverage", "spanned", "mutations")
#: Event times: reference 0 comes after the first watermark, and the end after any reference.
FIRST, END = 2, (1 << 31) + 2
LATENESS = "1 second"


def _time(tid: Column) -> Column:
    return F.timestamp_seconds(tid.cast("bigint") + FIRST)


def _one_input(alignments: DataFrame, references: DataFrame, rule: filters.ReadFilter, **options) -> DataFrame:
    """What an input's reads contribute, by reference as time, and a row without a position for the place of every read, counted or not."""
    good = filters.mapped(alignments).filter(filters.accepted(rule))
    counted = contributions(placed(good, references), **options).unionByName(tangled_contributions(good, references, **options))
    is_end = filters.has(filters.UNMAPPED)
    passed = alignments.select(
        F.when(is_end, F.lit(-1)).otherwise(F.col("tid")).alias("tid"), F.lit(-1).alias("pos"), *(F.lit(0.0).alias(c) for c in SUMS),
    )
    both = counted.unionByName(passed)
    at = F.when(F.col("tid") < 0, F.timestamp_seconds(F.lit(END))).otherwise(_time(F.col("tid")))
    return both.withColumn("at", at).withWatermark("at", LATENESS)


def finished_sums(inputs: list[DataFrame], references: DataFrame, rule: filters.ReadFilter | None = None, **options) -> DataFrame:
    """``tid, pos`` and the sums by position, as ``pileup`` has them, for a stream in append mode: a reference's rows come once all ``inputs`` have passed it.

    The state holds the references that some input is at or behind; ``refuse_returns`` refuses counted reads of one that comes back. Inputs without
    reads, or whose last reference is not followed by an unmapped read, hold back what they have not passed.
    """
    parts = [_one_input(alignments, references, rule or filters.ReadFilter(), **options) for alignments in inputs]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    # Places and ends are left out by one test that looks at the time too: any other would be moved ahead of the watermark, which must see them.
    counted = F.least(F.col("pos").cast("bigint"), F.lit(END - 1) - F.unix_seconds("at")) >= 0
    return every.filter(counted).groupBy("at", "tid", "pos").agg(*(exact_sum(c).alias(c) for c in SUMS)).select("tid", "pos", *SUMS)


class _Returns(StreamingQueryListener):
    def __init__(self, query: StreamingQuery):
        self.run, self.late = str(query.runId), 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if str(event.progress.runId) == self.run:
            self.late += sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)

    def onQueryTerminated(self, event) -> None:
        pass


def refuse_returns(spark: SparkSession, query: StreamingQuery, seconds: float | None = None, every: float = 0.5) -> bool:
    """Wait until ``query`` ends, for ``seconds`` at most, and say whether it has; stop it and fail when a reference comes back that was given out before."""
    listener, waited, ended = _Returns(query), 0.0, False
    spark.streams.addListener(listener)
    try:
        while not ended and (seconds is None or waited < seconds):
            ended, waited = bool(query.awaitTermination(every)), waited + every
            # What came before the listener did is in the query's own progress.
            if late := listener.late or sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators):
                query.stop()
                raise ValueError(f"an input is not sorted: {late} rows belong to references that were given out before")
    finally:
        spark.streams.removeListener(listener)
    return ended
