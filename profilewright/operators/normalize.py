"""One scale for several profiles, from the rates of all."""

from __future__ import annotations

import math
from bisect import bisect
from collections.abc import Callable
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import is_finite, nan

#: The percentile, and the bounds of the band, from the top, whose mean is taken.
PERCENTILE, TRIM_TOP, TRIM_BAND = 0.9, 0.02, 0.10
MIN_COVERAGE = 500.0
#: The quantile sketch's accuracy, how far from a share of the rates a bracket reaches, and rows of a bracket that are collected at most.
ACCURACY, REACH, MOST_ROWS = 20_000, 1e-4, 100_000


def pool(profiles: list[DataFrame], scheme: str = "ubr", min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Rates of all inputs that count: finite, and for ``ubr`` at a coverage above the floor."""
    rates = reduce(DataFrame.unionByName, [p.select("coverage", F.col("reactivity").cast("double").alias("rate")) for p in profiles])
    ok = is_finite(F.col("rate"))
    return rates.filter(ok & ~F.isnan("coverage") & (F.col("coverage") > min_coverage) if scheme == "ubr" else ok).select("rate")


def values_at(rates: DataFrame, shares: list[float], ranks_of: Callable[[int], list[int]], most: int = MOST_ROWS) -> tuple[int, list[float]]:
    """The number of rates, and those of the ranks ``ranks_of(number)``, from 0, which lie about ``shares`` of the way.

    A mergeable quantile sketch brackets all ranks in one pass; a second pass counts the rates in the brackets by value and the
    others in bulk. A rank whose bracket has too many values, or that its bracket missed, is looked for in its stretch alone.
    """
    rate, ends = F.col("rate"), [min(1.0, max(0.0, s + d)) for s in shares for d in (-REACH, REACH)]
    n, least, greatest, found = rates.agg(F.count("rate"), F.min("rate"), F.max("rate"), F.percentile_approx("rate", ends, ACCURACY)).first()
    if not n:
        return 0, []
    few = n * REACH < 8
    edges = [(least, greatest)] if few else sorted(zip(found[::2], found[1::2], strict=True))
    zone = reduce(Column.__add__, [(rate >= low).cast("int") + (rate > high).cast("int") for low, high in edges])
    inside = reduce(Column.__or__, [rate.between(low, high) for low, high in edges])
    about = [F.count(F.lit(1)).alias("n"), F.min("rate").alias("low"), F.max("rate").alias("high")]
    rows = rates.groupBy(zone.alias("zone"), F.when(inside, rate).alias("value")).agg(*about).limit(most + 1).collect()
    if len(rows) > most:
        rows = rates.groupBy(zone.alias("zone")).agg(*about).collect()
    rows.sort(key=lambda r: r["low"])
    starts, out = [0, *accumulate(r["n"] for r in rows)], []
    for rank in ranks_of(n):
        at = bisect(starts, rank) - 1
        row, k = rows[at], rank - starts[at]
        if row["low"] < row["high"]:
            stretch = rates.filter(rate.between(row["low"], row["high"]))
            # A sketch as accurate as it is asked to be leaves a small part; should it leave all, more rows are taken at once.
            out += values_at(stretch, [k / row["n"]], lambda _, k=k: [k], most if row["n"] < n else 2 * most)[1]
        else:
            out.append(row["low"])
    return n, out


def _factor(spark: SparkSession, value: float) -> DataFrame:
    return spark.range(1).select(F.lit(float(value)).alias("factor"))


def percentile_scale(rates: DataFrame) -> DataFrame:
    """``factor``: the 90th percentile, between ranks; 1 for an empty pool."""
    place = lambda n: PERCENTILE * (n - 1)
    n, found = values_at(rates, [PERCENTILE], lambda n: [math.floor(place(n)), math.ceil(place(n))])
    if not n:
        return _factor(rates.sparkSession, 1.0)
    low, high = found
    return _factor(rates.sparkSession, low + (high - low) * (place(n) - math.floor(place(n))))


def band_scale(rates: DataFrame) -> DataFrame:
    """``factor``: the mean of the ranks between the top 2 and the top 10 per cent, by halves rounded up; 1 for fewer than two rates. Ties at the ends count as often as their ranks lie in the band."""
    spark, rate = rates.sparkSession, F.col("rate")
    from_top = lambda n: [max(1, math.floor(part * n + 0.5)) - 1 for part in (TRIM_TOP, TRIM_BAND)]
    n, found = values_at(rates, [1 - TRIM_TOP, 1 - TRIM_BAND], lambda n: [n - 1 - k for k in from_top(n)])
    if n < 2:
        return _factor(spark, 1.0)
    (first, last), (high, low) = from_top(n), found
    if high == low:
        return _factor(spark, high)
    between = (rate < high) & (rate > low)
    above, inside, total, at_top = rates.agg(F.count_if(rate > high), F.count_if(between), F.coalesce(F.sum(F.when(between, rate)), F.lit(0.0)), F.count_if(rate == high)).first()
    at_high = at_top - (first - above)
    return _factor(spark, (high * at_high + total + low * (last - first + 1 - at_high - inside)) / (last - first + 1))


def recorded(factor: Column) -> Column:
    """The scale as it is written down: NaN where it cannot be used."""
    return F.when(F.isnan(factor) | (factor <= 0), nan()).otherwise(factor)


def divisor(factor: Column) -> Column:
    return F.when(F.isnan(factor) | (factor <= 0), 1.0).otherwise(factor)


def scale_of(profiles: list[DataFrame], scheme: str = "ubr", min_coverage: float = MIN_COVERAGE) -> DataFrame:
    if scheme not in ("ubr", "outlier"):
        raise ValueError("the scheme is ubr or outlier")
    rates = pool(profiles, scheme, min_coverage)
    return percentile_scale(rates) if scheme == "ubr" else band_scale(rates)


def apply_scale(profile: DataFrame, scale: DataFrame, clip_above: float | None = None) -> DataFrame:
    """Rates and errors over the scale (one row), in 64 bits, then narrowed; by choice rates above a bound become it, NaN stays."""
    joined = profile.crossJoin(F.broadcast(scale.select("factor")))
    scaled = lambda c: (F.col(c).cast("double") / divisor(F.col("factor"))).cast("float")
    rate = scaled("reactivity")
    if clip_above is not None:
        bound = F.lit(clip_above).cast("float")
        rate = F.when(~F.isnan(rate) & (rate > bound), bound).otherwise(rate)
    changed = {"reactivity": rate} | ({"error": scaled("error")} if "error" in profile.columns else {})
    return joined.withColumns(changed).select(*profile.columns)


def normalize(profiles: list[DataFrame], scheme: str = "ubr", min_coverage: float = MIN_COVERAGE, clip_above: float | None = None) -> tuple[list[DataFrame], DataFrame]:
    """Every input over the one scale, and ``norm``, the scale to record."""
    scale = scale_of(profiles, scheme, min_coverage)
    return [apply_scale(p, scale, clip_above) for p in profiles], scale.select(recorded(F.col("factor")).cast("float").alias("norm"))
