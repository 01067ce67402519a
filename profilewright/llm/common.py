"""What the operators on documents share: table access, the word rule, private column names and a join that hot keys don't hold up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..joins import spread_join  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; 0 for null."""
    one_blank = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.array_remove(F.split(one_blank, " "), "")), F.lit(0)).cast("long")


def private(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def with_results(df: DataFrame, results: Column, names: dict[str, str]) -> DataFrame:
    """``df`` with fields of the struct ``results`` as last columns, ``names`` maps fields to them; they take the place of columns of the same names."""
    held = private(df, "results")
    made = df.withColumn(held, results).drop(*names.values())
    return made.withColumns({column: F.col(f"{held}.{field}") for field, column in names.items()}).drop(held)
