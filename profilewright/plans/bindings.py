"""The driver's tables seen as alignments, profiles, scored positions and pairs, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..joins import tasks_for
from ..schema import nan

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASES = "ACGTACGTACGTACGTACGTACGTAC" * 2
READ, REF_LEN = 100, 120
#: A document has fewer reads, as a text is under 2**31 letters; and a reference of scores has the documents of so many ids at most.
READS_OF_ONE, PER_REFERENCE = 1 << 25, 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table of fewer splits than the session has cores, dealt out; a larger table stays where it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def references(spark: SparkSession) -> DataFrame:
    """Four references, one for each language, with bases by rule."""
    tid = F.col("id").cast("int")
    place = lambda p: ((p * 7 + F.col("id") * 13 + F.floor(p * p / 5)) % 4 + 1).cast("int")
    seq = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(REF_LEN - 1)), lambda p: F.substring(F.lit("ACGT"), place(p), F.lit(1))), "")
    return spark.range(4).select(tid.alias("tid"), F.concat(F.lit("ref"), tid.cast("string")).alias("name"), F.lit(None).cast("string").alias("comment"), seq.alias("seq"), F.lit(REF_LEN).alias("len"))


def text_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference for each document that has a text, its whole letters as bases; every third has no comment."""
    docs = table(spark, sf_dir, "documents").filter(F.length("text") > 0)
    seq = F.regexp_replace(F.translate("text", LETTERS, BASES), "[^ACGT]", "N")
    comment = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("number "), F.col("doc_id").cast("string")))
    return docs.select(F.col("doc_id").cast("int").alias("tid"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), comment.alias("comment"), seq.alias("seq"), F.length("text").alias("len"))


B5 = f"""refs AS (SELECT doc_id AS tid, 'doc' || doc_id AS name, CASE WHEN doc_id % 3 != 0 THEN 'number ' || doc_id END AS comment, regexp_replace(translate(text, '{LETTERS}', '{BASES}'), '[^ACGT]', 'N', 'g') AS seq, length(text) AS len FROM documents WHERE length(text) > 0)"""


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents cut into reads of 100 letters, with awkward flags, qualities and alignments by turns."""
    lang = F.when(F.col("lang") == "de", 0).when(F.col("lang") == "en", 1).when(F.col("lang") == "es", 2).otherwise(3)
    # A generator of one row: else the optimiser translates the whole text again for each read.
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    coded = docs.select("doc_id", lang.alias("tid"), F.explode(F.array(F.translate("text", LETTERS, BASES))).alias("coded"))
    cut = F.regexp_extract_all("coded", F.lit(f"(?s).{{1,{READ}}}"), F.lit(0))  # in one pass over the text
    reads = coded.filter(F.length("coded") > 0).select("doc_id", "tid", F.posexplode(cut).alias("chunk", "seq"))
    n, k = F.length("seq"), F.col("doc_id") + F.col("chunk")
    op = lambda *parts: F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    by_turn = F.when(k % 6 == 1, op("10M2D", n - 10, "M")).when(k % 6 == 2, op("10M3I", n - 13, "M")).when(k % 6 == 3, op("5S", n - 5, "M")).when(k % 6 == 5, op("8M2I1D", n - 10, "M"))
    flag = F.when(k % 19 == 0, 4).otherwise(F.when(k % 2 == 1, 16).otherwise(0) + F.when(k % 17 == 0, 256).otherwise(0))
    return reads.select(
        F.lit(0).alias("file_id"), (F.col("doc_id") * READS_OF_ONE + F.col("chunk")).alias("rec_no"), F.col("tid").cast("int").alias("tid"), (k % 24).alias("pos"), flag.cast("int").alias("flag"),
        F.when(k % 13 == 0, 255).otherwise((F.col("doc_id") * 7 + F.col("chunk")) % 61).cast("smallint").alias("mapq"),
        F.when((n >= 20) & (k % 6 != 0) & (k % 6 != 4), by_turn).otherwise(op(n, "M")).alias("cigar"), "seq",
        F.repeat(F.char((35 + k % 39).cast("int")), n).alias("qual"), n.alias("l_qseq"),
    )


B1 = rf"""
refs AS (SELECT tid, 'ref' || tid AS name, 120 AS len, string_agg(substr('ACGT', CAST((p * 7 + tid * 13 + (p * p) // 5) % 4 + 1 AS INT), 1), '' ORDER BY p) AS seq
         FROM unnest(range(0, 4)) AS t(tid), unnest(range(0, 120)) AS u(p) GROUP BY tid),
coded AS (SELECT doc_id, CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END AS tid, translate(text, '{LETTERS}', '{BASES}') AS coded FROM documents WHERE length(text) > 0),
cut AS (SELECT doc_id, tid, i AS chunk, doc_id + i AS k, substr(coded, i * 100 + 1, 100) AS seq FROM coded, unnest(range(0, (length(coded) - 1) // 100 + 1)) AS t(i)),
aln AS (SELECT doc_id * {READS_OF_ONE} + chunk AS rec_no, tid, k % 24 AS pos,
               CASE WHEN k % 19 = 0 THEN 4 ELSE CASE WHEN k % 2 = 1 THEN 16 ELSE 0 END + CASE WHEN k % 17 = 0 THEN 256 ELSE 0 END END AS flag,
               CASE WHEN k % 13 = 0 THEN 255 ELSE (doc_id * 7 + chunk) % 61 END AS mapq, seq, length(seq) AS n, 2 + k % 39 AS q,
               CASE WHEN length(seq) < 20 THEN length(seq) || 'M' WHEN k % 6 = 1 THEN '10M2D' || (length(seq) - 10) || 'M' WHEN k % 6 = 2 THEN '10M3I' || (length(seq) - 13) || 'M'
                    WHEN k % 6 = 3 THEN '5S' || (length(seq) - 5) || 'M' WHEN k % 6 = 5 THEN '8M2I1D' || (length(seq) - 10) || 'M' ELSE length(seq) || 'M' END AS cigar FROM cut),
mapped AS (SELECT *, flag & 256 = 0 AND mapq != 255 AND mapq >= 20 AS ok FROM aln WHERE flag & 4 = 0),
paths AS (SELECT * REPLACE (replace(cigar, '8M2I1D', '8M1I1M') AS cigar) FROM mapped WHERE ok),
raw_ops AS (SELECT rec_no, tid, pos, seq, q, n, i, CAST(regexp_extract_all(cigar, '([0-9]+)([MIDNSHP=X])', 1)[i] AS INT) AS len, regexp_extract_all(cigar, '([0-9]+)([MIDNSHP=X])', 2)[i] AS op
        FROM mapped, unnest(range(1, len(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]')) + 1)) AS t(i) WHERE ok),
ops AS (SELECT rec_no, tid, pos, seq, q, n, i, CAST(regexp_extract_all(cigar, '([0-9]+)([MIDNSHP=X])', 1)[i] AS INT) AS len, regexp_extract_all(cigar, '([0-9]+)([MIDNSHP=X])', 2)[i] AS op
        FROM paths, unnest(range(1, len(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]')) + 1)) AS t(i)),
raw_offs AS (SELECT *, CAST(coalesce(sum(CASE WHEN op IN ('M', 'I', 'S') THEN len ELSE 0 END) OVER w, 0) AS BIGINT) AS q0, CAST(pos + coalesce(sum(CASE WHEN op IN ('M', 'D') THEN len ELSE 0 END) OVER w, 0) AS BIGINT) AS r0
         FROM raw_ops WINDOW w AS (PARTITION BY rec_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
offs AS (SELECT *, CAST(coalesce(sum(CASE WHEN op IN ('M', 'I', 'S') THEN len ELSE 0 END) OVER w, 0) AS BIGINT) AS q0, CAST(pos + coalesce(sum(CASE WHEN op IN ('M', 'D') THEN len ELSE 0 END) OVER w, 0) AS BIGINT) AS r0
         FROM ops WINDOW w AS (PARTITION BY rec_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lost AS (SELECT DISTINCT rec_no FROM offs WHERE (op = 'M' AND r0 + offs.len > 120)),
each AS (SELECT offs.tid, r0 + j AS pos, op, j = offs.len - 1 AS is_last, substr(offs.seq, q0 + j + 1, 1) AS b, substr(refs.seq, r0 + j + 1, 1) AS r, least(0.75, power(10.0, -q / 10.0)) AS e
         FROM offs JOIN refs USING (tid), unnest(range(0, offs.len)) AS t(j) WHERE op IN ('M', 'D') AND rec_no NOT IN (SELECT rec_no FROM lost)),
pile AS (SELECT tid, pos, CAST(count(*) FILTER (op = 'M') AS DOUBLE) AS coverage, CAST(count(*) AS DOUBLE) AS spanned,
                sum(CASE WHEN op = 'D' THEN CASE WHEN is_last THEN 1.0 ELSE 0.0 END WHEN b NOT IN ('A', 'C', 'G', 'T') THEN 0.0
                         WHEN b = r THEN 0.005 * e / 3 / (0.995 * (1 - e) + 0.005 * e / 3)
                         ELSE 0.005 * (1 - e / 3) / 3 / (0.995 * e / 3 + 0.005 * (1 - e / 3) / 3) END) AS mutations FROM each GROUP BY tid, pos)
"""


def run_profile(spark: SparkSession, sf_dir: str, flag: str) -> DataFrame:
    """``tid, pos, base, coverage, spanned, mutations`` of one return flag: suppliers as references, line numbers as positions. Sums are of whole numbers."""
    lines = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == flag)
    return lines.groupBy(F.col("l_suppkey").cast("int").alias("tid"), (F.col("l_linenumber") - 1).cast("int").alias("pos")).agg(
        (F.first("l_suppkey") % 5 - 1).cast("tinyint").alias("base"), F.count(F.lit(1)).cast("double").alias("coverage"), F.sum(F.col("l_quantity").cast("long")).cast("double").alias("spanned"),
        (F.sum(F.col("l_quantity").cast("long") * F.round(F.abs("l_discount") * 100).cast("long")) / 100.0).alias("mutations"),
    )


def rates(spark: SparkSession, sf_dir: str, flag: str, min_depth: float = 1.0) -> DataFrame:
    """A profile of one flag. The control, N, has rates of 0 and NaN here and there."""
    from ..operators.profile import rate, rate_error

    found = run_profile(spark, sf_dir, flag).select("tid", "pos", "base", F.col("coverage").cast("float").alias("coverage"), rate(F.col("mutations"), F.col("spanned"), min_depth).cast("float").alias("reactivity"), rate_error(F.col("mutations"), F.col("spanned"), min_depth).cast("float").alias("error"))
    if flag == "N":
        bad = F.when((F.col("tid") + F.col("pos")) % 11 == 0, nan("float")).when((F.col("pos") == 6) & (F.col("tid") % 10 == 0), F.lit(0.0).cast("float"))
        found = found.withColumn("reactivity", F.coalesce(bad, "reactivity"))
    return found


def _sql_rates(name: str, flag: str) -> str:
    reactivity = "CAST(least(1.0, mutations / spanned) AS FLOAT)"
    if flag == "N":
        reactivity = f"CASE WHEN (tid + pos) % 11 = 0 THEN CAST('NaN' AS FLOAT) WHEN pos = 6 AND tid % 10 = 0 THEN CAST(0 AS FLOAT) ELSE {reactivity} END"
    return f"""
{name} AS (SELECT tid, pos, CAST(tid % 5 - 1 AS TINYINT) AS base, CAST(coverage AS FLOAT) AS coverage, spanned, mutations, {reactivity} AS reactivity,
  CAST(sqrt(least(1.0, mutations / spanned) * (1 - least(1.0, mutations / spanned)) / spanned) AS FLOAT) AS error
  FROM (SELECT l_suppkey AS tid, l_linenumber - 1 AS pos, CAST(count(*) AS DOUBLE) AS coverage, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS spanned,
        CAST(sum(CAST(l_quantity AS BIGINT) * CAST(round(abs(l_discount) * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS mutations FROM lineitem WHERE l_returnflag = '{flag}' GROUP BY 1, 2))"""


B2 = ",".join(_sql_rates(n, f) for n, f in (("treated", "R"), ("untreated", "A"), ("control", "N")))


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, tid, n_chars, mark``: documents as positions, open or paired by their quality, unknown without a label. A language has a reference for each thousand ids."""
    lang = F.when(F.col("lang") == "de", 0).when(F.col("lang") == "en", 1).when(F.col("lang") == "es", 2).otherwise(3)
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    tid = (F.floor(F.col("doc_id") / PER_REFERENCE) * 4 + lang).cast("int")
    docs = table(spark, sf_dir, "documents").select("doc_id", tid.alias("tid"), "n_chars").join(labels, "doc_id", "left")
    return docs.withColumn("mark", F.when(F.col("quality").isNull(), "-").when(F.col("quality") == 1, ".").otherwise("("))


def scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labelled documents as a profile (length as the rate), references and structures (quality as the pairing); what is not labelled has no known mark."""
    placed = marks(spark, sf_dir).withColumn("pos", F.row_number().over(Window.partitionBy("tid").orderBy("doc_id")) - 1)
    profile = placed.select("tid", "pos", F.lit(0).cast("tinyint").alias("base"), F.lit(1.0).cast("float").alias("coverage"), F.col("n_chars").cast("float").alias("reactivity"))
    spelled = placed.groupBy("tid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mark"))), lambda x: x["mark"]), "").alias("pairing"))
    refs = spelled.select("tid", F.concat(F.lit("ref"), F.col("tid").cast("string")).alias("name"), F.lit(None).cast("string").alias("comment"), F.repeat(F.lit("A"), F.length("pairing")).alias("seq"), F.length("pairing").alias("len"))
    return profile, refs, spelled.select(F.concat(F.lit("ref"), F.col("tid").cast("string")).alias("name"), "pairing")


SQL_TID = f"doc_id // {PER_REFERENCE} * 4 + CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END"
B3 = f"pts AS (SELECT {SQL_TID} AS tid, CAST(n_chars AS DOUBLE) AS value, quality = 1 AS open FROM documents JOIN labels USING (doc_id))"


def pair_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reads and line numbers as positions, mutated where a line was returned. Dealt once by order, to tasks by the number of lines: what follows groups by order too, so it is not shuffled again, and no task grows with the table."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    tasks = tasks_for(lines)
    lines = lines.repartition(tasks, "l_orderkey").join(orders.repartition(tasks, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    tid = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    events = lines.groupBy(tid.alias("tid"), F.col("l_orderkey").alias("read"), (F.col("l_linenumber") - 1).alias("pos")).agg(F.max(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)).alias("mutations"))
    return events.select("tid", "read", "pos", F.lit(1.0).alias("coverage"), F.lit(1.0).alias("spanned"), "mutations")


B4 = """ev AS (SELECT CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS tid, l_orderkey AS read, l_linenumber - 1 AS pos, max(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS m
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
sums AS (SELECT a.tid, a.pos AS i, b.pos AS j, CAST(count(*) AS DOUBLE) AS span, CAST(sum(a.m) AS DOUBLE) AS "left", CAST(sum(b.m) AS DOUBLE) AS "right", CAST(sum(a.m * b.m) AS DOUBLE) AS "both"
  FROM ev a JOIN ev b ON a.tid = b.tid AND a.read = b.read AND a.pos <= b.pos GROUP BY 1, 2, 3)"""
