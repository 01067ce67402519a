"""Profiles against known structures."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..joins import with_sums_before
from ..schema import is_finite
from .exact import exact_sum

#: Open positions of a reference whose precision-recall steps are put in a row, to be added one after another as the curve is walked.
WALKED = 1 << 16


def points(profile: DataFrame, references: DataFrame, structures: DataFrame, bases: str = "ACGU", min_coverage: float = 0.0) -> DataFrame:
    """``tid, value, open`` of positions to score: a known mark, one of the bases, a finite rate, and coverage at the floor or above. References are found by name; those whose structure has another length are left out."""
    if structures.groupBy("name").count().filter("count > 1").head(1):
        raise ValueError("a structure is given twice")
    known = references.join(structures, "name").filter(F.length("pairing") == F.col("len")).select("tid", "seq", "pairing")
    # A row a position on both sides: marks are spelled out once, and no long reference is a hot key.
    letters = F.arrays_zip(F.split("pairing", "").alias("mark"), F.split(F.translate(F.upper("seq"), "T", "U"), "").alias("base"))
    marks = known.select("tid", F.posexplode(letters).alias("pos", "l")).select("tid", "pos", "l.mark", "l.base")
    kept = (F.col("mark") != "-") & F.lit(bases.replace("T", "U")).contains(F.col("base")) & is_finite(F.col("reactivity")) & ~(F.col("coverage") < min_coverage)
    return profile.select("tid", "pos", "coverage", "reactivity").join(marks, ["tid", "pos"]).filter(kept).select("tid", F.col("reactivity").cast("double").alias("value"), (F.col("mark") == ".").alias("open"))


def refuse_longer(references: DataFrame, n_refs: int) -> None:
    """References stand for the rows of a profile by their order, so there cannot be more of them; fewer are accepted."""
    if (n := references.count()) > n_refs:
        raise ValueError(f"there are {n} references, but the profile has {n_refs}")


def wrong_lengths(references: DataFrame, structures: DataFrame) -> DataFrame:
    return references.join(structures, "name").filter(F.length("pairing") != F.col("len")).select("tid", "name", "len", F.length("pairing").alias("pairing_len"))


def metrics(scored: DataFrame) -> DataFrame:
    """``tid, paired, unpaired, auroc, auprc, mean_paired, mean_unpaired`` of references with both classes.

    Equal values are counted first: a value's mid-rank and its step of the precision-recall curve follow from running counts over
    distinct values, so ties share a rank and make one step. One reference's values may span any number of tasks.

    Steps of the curve are added from the highest value down, as its definition walks it: another order may end in another last
    digit, which shows where a printed score lies between two. A reference of more than ``WALKED`` open positions gets an exact
    sum, which has no order.
    """
    by_value = scored.groupBy("tid", "value").agg(F.count(F.lit(1)).alias("n"), F.count_if("open").alias("n_open"))
    summed = with_sums_before(by_value, "tid", "value", ["n", "n_open"], "scored")
    ranked = summed.withColumns({"midrank": F.col("before_n") + (F.col("n") + 1) / 2, "found": F.col("all_n_open") - F.col("before_n_open"), "seen": F.col("all_n") - F.col("before_n")})
    step, is_short = F.col("n_open") * F.col("found") / F.col("seen"), F.col("all_n_open") <= WALKED
    steps = F.sort_array(F.collect_list(F.when(is_short & (F.col("n_open") > 0), F.struct("value", step.alias("step")))), asc=False)
    walked = F.aggregate(steps, F.lit(0.0), lambda total, x: total + x["step"])
    sums = ranked.groupBy("tid").agg(
        F.sum("n_open").alias("unpaired"), F.sum(F.col("n") - F.col("n_open")).alias("paired"), F.sum(F.col("midrank") * F.col("n_open")).alias("rank_sum"),
        F.coalesce(exact_sum(F.when(~is_short, step)), walked).alias("precision_sum"),
        F.sum(F.col("value") * F.col("n_open")).alias("open_sum"), F.sum(F.col("value") * (F.col("n") - F.col("n_open"))).alias("paired_sum"),
    )
    u, p = F.col("unpaired"), F.col("paired")
    return sums.filter((u > 0) & (p > 0)).select(
        "tid", "paired", "unpaired", ((F.col("rank_sum") - u * (u + 1) / 2) / (u * p)).alias("auroc"), (F.col("precision_sum") / u).alias("auprc"), (F.col("paired_sum") / p).alias("mean_paired"), (F.col("open_sum") / u).alias("mean_unpaired")
    )


def score(profile: DataFrame, references: DataFrame, structures: DataFrame, bases: str = "ACGU", min_coverage: float = 0.0) -> DataFrame:
    """``metrics`` by reference, with its name."""
    found = metrics(points(profile, references, structures, bases, min_coverage))
    return references.select("tid", "name").join(found, "tid")


def printed(number: str, value: str) -> Column:
    """``value`` as C prints it: the double itself is rounded, and halves go to the even digit."""

    @F.pandas_udf("string")
    def shown(values: pd.Series) -> pd.Series:
        return values.map(lambda x: number % x, na_action="ignore")

    return shown(F.col(value).cast("double")).alias(value)


def as_csv_lines(scores: DataFrame) -> DataFrame:
    """The scores as they are printed, in the order of the references."""
    return scores.orderBy("tid").select("name", "paired", "unpaired", *(printed("%.5f", c) for c in ("auroc", "auprc")), *(printed("%.6g", c) for c in ("mean_paired", "mean_unpaired")))
