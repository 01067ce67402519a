"""Views of the driver's tables stay bounded and distinct as the tables grow."""

from pyspark.sql import functions as F

from profilewright.plans import bindings, registry


def folder(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic")).write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_reads_of_a_very_long_text_have_numbers_of_their_own(spark, tmp_path):
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, F.repeat(F.lit("abcdefghij"), 700_000)).otherwise("ab" * 100).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    reads = bindings.alignments(spark, folder(spark, tmp_path, docs)).select("rec_no")
    assert reads.count() == reads.distinct().count() == 70_000 + 4


def test_references_and_structures_hold_a_thousand_documents_at_most(spark, tmp_path):
    """Ids far apart and many documents of one language: a reference a thousand ids, and no line of a structure is too long."""
    docs = spark.range(0, 9000).select((F.col("id") + F.when(F.col("id") > 6000, 10_000_000).otherwise(0)).alias("doc_id"), F.lit("w").alias("text"), F.lit("de").alias("lang"), F.lit("s").alias("source"), (F.col("id") % 97 + 1).alias("n_chars"))
    d = folder(spark, tmp_path, docs)
    profile, refs, structures = bindings.scored(spark, d)
    assert profile.groupBy("tid").count().agg(F.max("count")).first()[0] == 1000 and refs.agg(F.max("len")).first()[0] == 1000
    assert structures.count() == refs.count() == 10
    found = registry.QUERIES["structure_round_trip"](spark, d)
    assert found.agg(F.count("name"), F.sum(F.length("pairing"))).first() == (10, 9000)
    assert registry.QUERIES["score_auroc"](spark, d).count() == 9  # document 6000 is alone in its reference, so it has one class
