"""Sums of reads to the tables of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import __version__
from ..functions.scalars import base_code
from ..pieces import heads, letters
from ..schema import nan
from ..scratch import materialize
from . import filters, hmm, pairs
from .exact import exact_sum
from .pileup import is_tangled, pileup


def known(evidence: Column, min_depth: float) -> Column:
    return (evidence > 0) & (evidence >= min_depth)


def rate(mutations: Column, spanned: Column, min_depth: float = 1.0) -> Column:
    """Mutations over span, 1 at most; NaN where the span is 0 or less than ``min_depth``."""
    # The guard inside keeps the division defined where a plan evaluates both branches.
    divided = mutations / F.when(spanned > 0, spanned).otherwise(F.lit(1.0))
    return F.when(known(spanned, min_depth), F.least(F.lit(1.0), divided)).otherwise(nan())


def rate_error(mutations: Column, spanned: Column, min_depth: float = 1.0) -> Column:
    """Standard error of the rate; NaN where that is."""
    r = rate(mutations, spanned, min_depth)
    return F.when(known(spanned, min_depth), F.sqrt(r * (1 - r) / F.when(spanned > 0, spanned).otherwise(F.lit(1.0)))).otherwise(nan())


def skeleton(references: DataFrame) -> DataFrame:
    """``tid, pos, base``: a row for each position of each reference, read or not."""
    return letters(references).select("tid", "pos", base_code(F.col("letter")).alias("base"))


def profile(references: DataFrame, sums: DataFrame, min_depth: float = 1.0) -> DataFrame:
    """The profile table of ``tid, pos, coverage, spanned, mutations``."""
    found = skeleton(references).join(sums, ["tid", "pos"], "left")
    m, s = F.coalesce("mutations", F.lit(0.0)), F.coalesce("spanned", F.lit(0.0))
    return found.select("tid", "pos", "base", F.coalesce("coverage", F.lit(0.0)).cast("float").alias("coverage"), rate(m, s, min_depth).cast("float").alias("reactivity"), rate_error(m, s, min_depth).cast("float").alias("error"))


def length_histogram(counted: DataFrame, cap: int) -> DataFrame:
    """Reads by stored length, up to twice the longest reference; longer ones are in no bin."""
    return counted.filter((F.col("l_qseq") >= 1) & (F.col("l_qseq") <= 2 * cap)).groupBy("tid", F.col("l_qseq").alias("length")).agg(F.count(F.lit(1)).alias("n"))


def ref_stats(references: DataFrame, reads: DataFrame) -> DataFrame:
    """``reads(tid, is_counted)`` of mapped reads by reference; a row for each reference."""
    by_ref = reads.groupBy("tid").agg(F.count_if("is_counted").alias("counted"), F.count_if(~F.col("is_counted")).alias("rejected"))
    return heads(references).select("tid", "name", "len").join(by_ref, "tid", "left").fillna(0, ["counted", "rejected"])


def run_table(references: DataFrame, alignments: DataFrame) -> DataFrame:
    sizes = heads(references).agg(F.count(F.lit(1)).cast("int").alias("n_refs"), F.coalesce(F.max("len"), F.lit(0)).alias("cap"))
    return filters.unmapped_total(alignments).crossJoin(F.broadcast(sizes)).select(  # one row each
        F.lit("profilewright").alias("program"), F.lit(__version__).alias("version"), "n_refs", "cap", "unmapped", nan("float").alias("norm")
    )


def count_reads(alignments: DataFrame, references: DataFrame, rule: filters.ReadFilter | None = None, band: int = 2, model: hmm.Model | None = None, min_phred: int = 0, min_depth: float = 1.0, with_pairs: bool = False) -> dict[str, DataFrame]:
    """All tables of a run: ``profile, ref_stats, lengths, run`` and, if asked, ``pairs``. The model runs once; its sums are written to the shared folder. References may come in pieces."""
    rule = rule or filters.ReadFilter()
    reads = filters.mapped(filters.refuse_paired(alignments)).withColumn("accepted", filters.accepted(rule))
    good = reads.filter("accepted")
    parts = materialize(hmm.counts(good, references, band, model, min_phred, with_pairs), "counts")
    sums = parts.filter("kind = 'pos'").groupBy("tid", F.col("i").alias("pos")).agg(exact_sum("a").alias("coverage"), exact_sum("b").alias("spanned"), exact_sum("c").alias("mutations"))
    by_ref = parts.filter("kind = 'read'").groupBy("tid").agg(F.sum("a").cast("long").alias("counted"), F.sum("b").cast("long").alias("no_path"))
    refused = reads.filter(~F.col("accepted")).groupBy("tid").agg(F.count(F.lit(1)).alias("refused"))
    stats = heads(references).select("tid", "name", "len").join(by_ref, "tid", "left").join(refused, "tid", "left").fillna(0, ["counted", "no_path", "refused"])
    cap = heads(references).agg(F.coalesce(F.max("len"), F.lit(0))).first()[0]
    out = {
        "profile": profile(references, sums, min_depth),
        "ref_stats": stats.select("tid", "name", "len", "counted", (F.col("no_path") + F.col("refused")).alias("rejected")),
        "lengths": length_histogram(good, cap),
        "run": run_table(references, alignments),
    }
    if with_pairs:
        out["pairs"] = pairs.statistics(parts.filter("kind = 'pair'").groupBy("tid", "i", "j").agg(*(F.sum(c).alias(n) for c, n in zip("abcde", pairs.SUMS, strict=True))), min_depth)
    return out


def to_dense(table: DataFrame, references: DataFrame, field: str, fill, kind: str = "float") -> DataFrame:
    """``tid, values``: one padded array a reference, as long as the longest."""
    cap = references.agg(F.max("len")).first()[0] or 0
    rows = table.groupBy("tid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", field))), lambda x: x[field].cast(kind)).alias("own"))  # a row a position
    return rows.select("tid", F.concat("own", F.array_repeat(F.lit(fill).cast(kind), F.lit(cap) - F.size("own"))).alias("values"))


def tangled_contributions(good: DataFrame, references: DataFrame, **options) -> DataFrame:
    """``tid, pos, coverage, spanned, mutations`` of accepted reads that the closed form leaves out, by the model with a band of nothing, summed by task."""
    weights = {f"{k}_weight": v for k, v in options.items() if k in ("substitution", "deletion", "insertion")}
    model = hmm.Model(**weights, modification=options.get("modification", hmm.Model.modification))
    parts = hmm.counts(good.filter(is_tangled(F.col("cigar"))), references, 0, model, options.get("min_phred", 0)).filter("kind = 'pos'")
    return parts.select("tid", F.col("i").alias("pos"), F.col("a").alias("coverage"), F.col("b").alias("spanned"), F.col("c").alias("mutations"))


def count_along_alignments(alignments: DataFrame, references: DataFrame, rule: filters.ReadFilter | None = None, min_depth: float = 1.0, **options) -> DataFrame:
    """The profile with a band of nothing, in closed form. Only reads whose insertions and deletions touch in ways that leave several paths go through the model."""
    good = filters.mapped(alignments).filter(filters.accepted(rule or filters.ReadFilter()))
    both = pileup(good, references, **options).unionByName(tangled_contributions(good, references, **options))
    return profile(references, both.groupBy("tid", "pos").agg(*(exact_sum(c).alias(c) for c in ("coverage", "spanned", "mutations"))), min_depth)
