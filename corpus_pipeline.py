"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

A stage takes (spark, docs, folder of the tables). All but the last return the columns of ``documents``; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from profilewright.llm import decontaminate, jaccard, language, mixing, secrets
from profilewright.llm.common import private, table
from profilewright.scratch import materialize

#: Below this cosine with every language a text is not taken for any.
LEAST_SCORE = 0.05
MARK = "[SECRET]"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is determined; ``lang`` stays as it is."""
    lang, score = private(docs, "lang_pred"), private(docs, "score")
    found = language.predict(docs, language.learn_unheld(docs), into=(lang, score))
    return found.filter((F.col(lang) != language.UNDETERMINED) & (F.col(score) >= LEAST_SCORE)).drop(lang, score)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by links, keep the one with the smallest doc_id: each of its different texts once, in the first row by a hash of the other columns, which may be of any type. Rows without a doc_id stay."""
    firsts = jaccard.link_components(docs).filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    others = F.to_json(F.struct(F.lit(0).alias(private(docs, "none")), *(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text"))))
    first_row = Window.partitionBy("doc_id", "text").orderBy(F.xxhash64(others), others)
    nth = private(docs, "nth")
    kept = docs.filter(F.col("doc_id").isNotNull()).join(firsts, "doc_id", "left_semi").withColumn(nth, F.row_number().over(first_row)).filter(F.col(nth) == 1)
    return kept.drop(nth).select(*docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which at least a twentieth of the words lies in benchmark windows."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put a mark in place of every secret; all documents stay, and ``n_chars`` counts what is left."""
    clean = secrets.redact(docs, MARK)
    return clean.withColumn("n_chars", secrets.n_chars(F.col("text"))) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source: documents of which words are taken, a row each, by their first copy, with the positions of all copies; ``mixing.in_order`` deals out the copies."""
    return mixing.by_first_copy(mixing.mix(docs, keep=("text",)))


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", remove_contaminated),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
]

#: SQL cannot express the first stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
