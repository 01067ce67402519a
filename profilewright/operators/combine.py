"""Two profiles to one: a background subtracted, or a control divided by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import fields_for, nan

Rule = Callable[[Callable[[str, int], Column]], Column]


def _added(field: str) -> Rule:
    return lambda of: (of(field, 0) + of(field, 1)).cast("float")


def _same(of) -> Column:
    return of("base", 0)


def subtract_rules(clip: bool = False) -> dict[str, Rule]:
    """Differences of rates, by choice 0 at least (NaN stays), and errors in quadrature; all in 32-bit floats."""
    def reactivity(of) -> Column:
        x = (of("reactivity", 0) - of("reactivity", 1)).cast("float")
        return F.when(x < 0, F.lit(0.0).cast("float")).otherwise(x) if clip else x

    def error(of) -> Column:
        square = lambda k: (of("error", k) * of("error", k)).cast("float")
        return F.sqrt((square(0) + square(1)).cast("float")).cast("float")

    return {"coverage": _added("coverage"), "reactivity": reactivity, "error": error, "base": _same}


def divide_rules() -> dict[str, Rule]:
    """Rates over a control that is above 0, else NaN, with the ratio's error."""
    def over(of) -> tuple[Column, Column]:
        d = of("reactivity", 1)
        ok = ~F.isnan(d) & (d > 0)
        return ok, F.when(ok, d).otherwise(F.lit(1.0).cast("float"))

    def reactivity(of) -> Column:
        ok, d = over(of)
        return F.when(ok, (of("reactivity", 0) / d).cast("float")).otherwise(nan("float"))

    def error(of) -> Column:
        ok, d = over(of)
        scaled = ((of("reactivity", 0) / d).cast("float") * of("error", 1)).cast("float")
        total = F.sqrt(((of("error", 0) * of("error", 0)).cast("float") + (scaled * scaled).cast("float")).cast("float")).cast("float")
        return F.when(ok, (total / d).cast("float")).otherwise(nan("float"))

    return {"coverage": _added("coverage"), "reactivity": reactivity, "error": error, "base": _same}


def combine(first: DataFrame, second: DataFrame, rules: dict[str, Rule], fields: list[str]) -> DataFrame:
    """Join by (tid, pos) and apply each field's rule, which may read any field of either side."""
    sides = [df.select("tid", "pos", *(F.col(c).alias(f"{c}_{k}") for c in fields)) for k, df in enumerate((first, second))]
    joined = sides[0].join(sides[1], ["tid", "pos"])
    return joined.select("tid", "pos", *(rules[f](lambda name, k: F.col(f"{name}_{k}")).alias(f) for f in fields))


def subtract(treated: DataFrame, untreated: DataFrame, clip: bool = False) -> DataFrame:
    return combine(treated, untreated, subtract_rules(clip), fields_for("sub", treated, untreated))


def divide(rates: DataFrame, control: DataFrame) -> DataFrame:
    return combine(rates, control, divide_rules(), fields_for("div", rates, control))


def disagreements(first: DataFrame, second: DataFrame) -> DataFrame:
    """``unmatched, different``: positions that one side lacks, and positions whose bases differ; a combination needs 0 and 0."""
    a, b = (df.select("tid", "pos", F.col("base").alias(f"base_{k}"), F.lit(1).alias(f"has_{k}")) for k, df in enumerate((first, second)))
    both = a.join(b, ["tid", "pos"], "full")
    return both.agg(
        F.count_if(F.col("has_0").isNull() | F.col("has_1").isNull()).alias("unmatched"),
        F.count_if(F.col("has_0").isNotNull() & F.col("has_1").isNotNull() & ~F.col("base_0").eqNullSafe(F.col("base_1"))).alias("different"),
    )


def require_agreement(first: DataFrame, second: DataFrame) -> None:
    found = disagreements(first, second).first()
    if found["unmatched"] or found["different"]:
        raise ValueError(f"the profiles differ: {found['unmatched']} positions unmatched, {found['different']} bases different")


def add_counts(first: DataFrame, second: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Counts of either side summed; a count that one side lacks is 0."""
    both = first.select(*keys, *values).unionByName(second.select(*keys, *values))
    return both.groupBy(*keys).agg(*(F.sum(v).cast("long").alias(v) for v in values))
