"""Which reads are counted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import placed_length

PAIRED, UNMAPPED, REVERSE, SECONDARY = 0x1, 0x4, 0x10, 0x100
NO_MAPQ = 255


@dataclass(frozen=True)
class ReadFilter:
    """Bounds of a read; a length of 0 is no bound."""

    min_mapq: int = 20
    min_length: int = 0
    max_length: int = 0
    strands: frozenset[str] = frozenset({"forward", "reverse"})

    def __post_init__(self):
        if not 0 <= self.min_mapq <= 254 or not self.strands or not self.strands <= {"forward", "reverse"}:
            raise ValueError("min_mapq lies in 0-254, and strands are forward, reverse or both")
        if min(self.min_length, self.max_length) < 0 or self.max_length and self.max_length < self.min_length:
            raise ValueError("no length satisfies the bounds")


def has(flag: int) -> Column:
    return F.col("flag").bitwiseAND(flag) != 0


def mapq_ok(min_mapq: int) -> Column:
    """255 means that no quality is known."""
    return (F.col("mapq") != NO_MAPQ) & (F.col("mapq") >= min_mapq)


def strand_ok(strands: frozenset[str]) -> Column:
    return (has(REVERSE) & F.lit("reverse" in strands)) | (~has(REVERSE) & F.lit("forward" in strands))


def length_ok(min_length: int, max_length: int) -> Column:
    ok = F.col("l_qseq") >= min_length
    return ok & (F.col("l_qseq") <= max_length) if max_length else ok


def accepted(rule: ReadFilter) -> Column:
    """A mapped read with a sequence and a placement that is primary and within all bounds."""
    return F.coalesce(
        F.col("seq").isNotNull() & ~has(SECONDARY) & mapq_ok(rule.min_mapq) & strand_ok(rule.strands) & length_ok(rule.min_length, rule.max_length) & (placed_length(F.col("cigar"), F.col("l_qseq")) > 0),
        F.lit(False),
    )


def mapped(alignments: DataFrame) -> DataFrame:
    """Without the unmapped reads; a mapped one without a reference fails the run."""
    checked = F.when(F.col("tid") < 0, F.raise_error(F.lit("a mapped read without a reference"))).otherwise(F.col("tid"))
    return alignments.filter(~has(UNMAPPED)).withColumn("tid", checked.cast("int"))


def unmapped_total(alignments: DataFrame) -> DataFrame:
    return alignments.agg(F.count_if(has(UNMAPPED)).alias("unmapped"))


def paired_violations(alignments: DataFrame) -> DataFrame:
    """Paired reads, mapped or not; a run refuses to start with any."""
    return alignments.agg(F.count_if(has(PAIRED)).alias("paired"))


def refuse_paired(alignments: DataFrame) -> DataFrame:
    """The same reads, failing at the first paired one."""
    return alignments.withColumn("flag", F.when(has(PAIRED), F.raise_error(F.lit("paired reads are not counted")).cast("int")).otherwise(F.col("flag")))


#: Records of a block, inside which order is looked at by one task.
ORDER_BLOCK = 1 << 20


def out_of_order(alignments: DataFrame) -> DataFrame:
    """Records whose reference comes before that of the record ahead of them in their file; sorted files have none. Files are looked at in blocks, and each block at the end of the one before."""
    rows = alignments.filter(~has(UNMAPPED)).withColumn("block", F.floor(F.col("rec_no") / ORDER_BLOCK))
    ends = rows.groupBy("file_id", "block").agg(F.max(F.struct("rec_no", "tid")).alias("end"))
    before = ends.select("file_id", "block", F.lag("end.tid").over(Window.partitionBy("file_id").orderBy("block")).alias("before"))  # a row a block
    ahead = F.coalesce(F.lag("tid").over(Window.partitionBy("file_id", "block").orderBy("rec_no")), "before")
    return rows.join(before, ["file_id", "block"]).withColumn("ahead", ahead).filter(F.col("tid") < F.col("ahead")).drop("ahead", "before", "block")


def refuse_disorder(alignments: DataFrame) -> None:
    """Refuse files in which some reference's records come before those of a reference ahead of it: a row a reference is compared."""
    spans = alignments.filter(~has(UNMAPPED)).groupBy("file_id", "tid").agg(F.min("rec_no").alias("first"), F.max("rec_no").alias("last"))
    ahead = F.lag("last").over(Window.partitionBy("file_id").orderBy("tid"))
    if bad := spans.withColumn("ahead", ahead).filter(F.col("first") < F.col("ahead")).head(1):
        raise ValueError(f"file {bad[0]['file_id']} is not sorted: reference {bad[0]['tid']} comes too early")
