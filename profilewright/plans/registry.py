"""Registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import pieces
from ..functions import scalars
from ..joins import with_stretch
from ..operators import combine, filters, hmm, normalize, pairs, profile, score, verify
from ..operators.pileup import pileup, placed
from ..schema import FILLS, nan
from ..scratch import own_dir, written_text
from ..sources import runs, text
from . import bindings as b
from .model_sql import B5

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def shown(x: Column, digits: int = 6) -> Column:
    """Rounded for comparison, with null for NaN."""
    x = x.cast("double")
    return F.when(~F.isnan(x), F.round(x, digits))


def sql_shown(x: str, digits: int = 6) -> str:
    return f"CASE WHEN NOT isnan(CAST({x} AS DOUBLE)) THEN round(CAST({x} AS DOUBLE), {digits}) END"


# --- reads -----------------------------------------------------------------------------------------------------------------


def _mapped(spark, d, **rule) -> DataFrame:
    return filters.mapped(b.alignments(spark, d)).withColumn("accepted", filters.accepted(filters.ReadFilter(**rule)))


def _accept_counts(spark, d, **rule) -> DataFrame:
    return profile.ref_stats(b.references(spark), _mapped(spark, d, **rule).select("tid", F.col("accepted").alias("is_counted"))).select("tid", "counted", "rejected")


def _accept_sql(extra: str = "ok") -> str:
    return f"WITH {b.B1} SELECT CAST(refs.tid AS INT) AS tid, count(*) FILTER ({extra}) AS counted, count(*) FILTER (mapped.tid IS NOT NULL AND NOT ({extra})) AS rejected FROM refs LEFT JOIN mapped USING (tid) GROUP BY 1"


query("flt_accept_counts", _accept_sql())(_accept_counts)
query("flt_strand_forward", _accept_sql("ok AND flag & 16 = 0"))(lambda s, d: _accept_counts(s, d, strands=frozenset({"forward"})))
query("flt_strand_reverse", _accept_sql("ok AND flag & 16 != 0"))(lambda s, d: _accept_counts(s, d, strands=frozenset({"reverse"})))
query("flt_length_bounds", _accept_sql("ok AND n BETWEEN 40 AND 99"))(lambda s, d: _accept_counts(s, d, min_length=40, max_length=99))
query("flt_mapq_unavailable", _accept_sql("flag & 256 = 0 AND mapq != 255"))(lambda s, d: _accept_counts(s, d, min_mapq=0))


@query("flt_unmapped_total", f"WITH {b.B1} SELECT count(*) FILTER (flag & 4 != 0) AS unmapped FROM aln")
def flt_unmapped_total(spark, d):
    return filters.unmapped_total(b.alignments(spark, d))


@query("flt_paired_violations", f"WITH {b.B1} SELECT count(*) FILTER (flag & 1 != 0) AS paired FROM aln")
def flt_paired_violations(spark, d):
    return filters.paired_violations(b.alignments(spark, d))


@query("flt_out_of_order", f"WITH {b.B1} SELECT count(*) AS n FROM (SELECT tid, lag(tid) OVER (PARTITION BY tid // 2 ORDER BY rec_no) AS ahead FROM mapped) WHERE tid < ahead")
def flt_out_of_order(spark, d):
    return filters.out_of_order(b.alignments(spark, d).withColumn("file_id", F.floor(F.col("tid") / 2))).agg(F.count(F.lit(1)).alias("n"))


@query("cigar_placements", f"WITH {b.B1} SELECT rec_no, CAST(i - 1 AS INT) AS op_no, op, len, CAST(q0 AS BIGINT) AS query, r0 AS ref FROM raw_offs")
def cigar_placements(spark, d):
    ops = _mapped(spark, d).filter("accepted").select("rec_no", F.posexplode(scalars.cigar_ops(F.col("cigar"), F.col("pos"))).alias("op_no", "o"))
    return ops.select("rec_no", "op_no", "o.op", "o.len", F.col("o.query").cast("long").alias("query"), F.col("o.ref").cast("long").alias("ref"))


@query("cigar_reference_span", f"WITH {b.B1} SELECT rec_no, CAST(coalesce(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MDN=X]', 1), lambda x: CAST(x AS BIGINT))), 0) AS BIGINT) AS span, CAST(n - CASE WHEN cigar LIKE '5S%' THEN 5 ELSE 0 END AS BIGINT) AS placed FROM aln")
def cigar_reference_span(spark, d):
    return b.alignments(spark, d).select("rec_no", scalars.reference_span(F.col("cigar")).cast("long").alias("span"), scalars.placed_length(F.col("cigar"), F.col("l_qseq")).cast("long").alias("placed"))


def _by_quality(spark, d) -> DataFrame:
    return b.alignments(spark, d).groupBy((F.ascii("qual") - 33).cast("long").alias("q")).agg(F.count(F.lit(1)).alias("reads"))


@query("phred_error_table", f"WITH {b.B1} SELECT CAST(q AS BIGINT) AS q, count(*) AS reads, round(least(0.75, power(10.0, -q / 10.0)), 12) AS error, round(CASE WHEN q < 20 THEN 0.75 ELSE least(0.75, power(10.0, -q / 10.0)) END, 12) AS floored FROM aln GROUP BY q")
def phred_error_table(spark, d):
    """The errors of the qualities that reads have."""
    return _by_quality(spark, d).select("q", "reads", F.round(scalars.phred_error(F.col("q")), 12).alias("error"), F.round(scalars.phred_error(F.col("q"), 20), 12).alias("floored"))


@query("emission_shares", f"WITH {b.B1} SELECT CAST(q AS BIGINT) AS q, reads, round(0.005 * e / 3 / (0.995 * (1 - e) + 0.005 * e / 3), 10) AS same, round(0.005 * (1 - e / 3) / 3 / (0.995 * e / 3 + 0.005 * (1 - e / 3) / 3), 10) AS other FROM (SELECT q, count(*) AS reads, least(0.75, power(10.0, -q / 10.0)) AS e FROM aln GROUP BY q)")
def emission_shares(spark, d):
    e = scalars.phred_error(F.col("q"))
    return _by_quality(spark, d).select("q", "reads", F.round(scalars.share_if_same(e), 10).alias("same"), F.round(scalars.share_if_other(e), 10).alias("other"))


_PILE_SQL = f"WITH {b.B1} SELECT CAST(tid AS INT) AS tid, CAST(pos AS INT) AS pos, round(coverage, 4) AS coverage, round(spanned, 4) AS spanned, round(mutations, 4) AS mutations FROM pile"


def _rounded_sums(sums: DataFrame) -> DataFrame:
    return sums.select("tid", "pos", *(F.round(c, 4).alias(c) for c in ("coverage", "spanned", "mutations")))


@query("pileup_band0", _PILE_SQL)
def pileup_band0(spark, d):
    return _rounded_sums(pileup(_mapped(spark, d).filter("accepted"), b.references(spark)))


def _hmm_sums(spark, d, **options) -> DataFrame:
    parts = hmm.counts(_mapped(spark, d).filter("accepted"), b.references(spark), **options)
    return parts.filter("kind = 'pos'").groupBy("tid", F.col("i").alias("pos")).agg(F.sum("a").alias("coverage"), F.sum("b").alias("spanned"), F.sum("c").alias("mutations"))


@query("hmm_band0_udf", _PILE_SQL)
def hmm_band0_udf(spark, d):
    return _rounded_sums(_hmm_sums(spark, d, band=0))


_RATE = "least(1.0, m / s)"
_BAND2 = f"""WITH RECURSIVE {b.B1}, {B5}, t AS (SELECT tid, pos, sum(cov) AS c, sum(spn) AS s, sum(mut) AS m FROM win GROUP BY 1, 2),
j AS (SELECT refs.tid, p AS pos, instr('ACGT', substr(seq, p + 1, 1)) - 1 AS base, coalesce(c, 0) AS c, coalesce(s, 0) AS s, coalesce(m, 0) AS m FROM refs JOIN unnest(range(0, 120)) AS u(p) ON true LEFT JOIN t ON t.tid = refs.tid AND t.pos = p)
SELECT CAST(tid AS INT) AS tid, CAST(pos AS INT) AS pos, CAST(base AS TINYINT) AS base, round(CAST(CAST(c AS FLOAT) AS DOUBLE), 3) AS coverage, CASE WHEN s >= 1 THEN round(CAST(CAST({_RATE} AS FLOAT) AS DOUBLE), 5) END AS reactivity,
CASE WHEN s >= 1 THEN round(CAST(CAST(sqrt({_RATE} * (1 - {_RATE}) / s) AS FLOAT) AS DOUBLE), 5) END AS error FROM j"""


@query("hmm_band2_profile", _BAND2)
def hmm_band2_profile(spark, d):
    found = profile.count_reads(b.alignments(spark, d), b.references(spark))["profile"]
    return found.select("tid", "pos", "base", F.round(F.col("coverage").cast("double"), 3).alias("coverage"), shown(F.col("reactivity"), 5).alias("reactivity"), shown(F.col("error"), 5).alias("error"))


@query("hmm_band2_invariants", f"WITH {b.B1} SELECT count(*) AS mapped, true AS adds_up, true AS covered_within, true AS rates_within FROM mapped")
def hmm_band2_invariants(spark, d):
    run = profile.count_reads(b.alignments(spark, d), b.references(spark))
    good = _mapped(spark, d)
    bases = good.agg(F.count(F.lit(1)).alias("mapped"), F.sum(F.when(F.col("accepted"), scalars.placed_length(F.col("cigar"), F.col("l_qseq")))).alias("placed"))
    stats = run["ref_stats"].agg(F.sum(F.col("counted") + F.col("rejected")).alias("reads"))
    rates = run["profile"].agg(F.sum("coverage").alias("covered"), F.bool_and(F.isnan("reactivity") | F.col("reactivity").between(0, 1)).alias("rates_within"))
    return bases.crossJoin(stats).crossJoin(rates).select("mapped", (F.col("mapped") == F.col("reads")).alias("adds_up"), (F.col("covered") <= F.col("placed") * 1.0001).alias("covered_within"), "rates_within")


def _narrow(x: str, digits: int) -> str:
    """Narrowed to 32 bits, then rounded; no negative zero."""
    return f"round(CAST(CAST({x} AS FLOAT) AS DOUBLE), {digits}) + 0.0"


_PAIRWISE = f"""WITH RECURSIVE {b.B1}, {B5}, kept AS MATERIALIZED (SELECT * FROM win WHERE spn > 0),
sums AS (SELECT x.tid, x.pos AS i, y.pos AS j, sum(x.spn * y.spn) AS span, sum(x.mut * y.spn) AS "left", sum(x.spn * y.mut) AS "right", sum(x.mut * y.mut) AS "both", sum(x.cov * y.cov) AS covered
  FROM kept x JOIN kept y ON x.rec_no = y.rec_no AND x.pos <= y.pos GROUP BY 1, 2, 3),
st AS (SELECT tid, i, j, span, "left" * (span - "left") * "right" * (span - "right") AS scale, "both" * span - "left" * "right" AS top, "both" / nullif("right", 0) AS conditional, covered FROM sums
  UNION ALL SELECT tid, j, i, span, "left" * (span - "left") * "right" * (span - "right"), "both" * span - "left" * "right", "both" / nullif("left", 0), covered FROM sums WHERE i < j)
SELECT CAST(tid AS INT) AS tid, CAST(i AS INT) AS i, CAST(j AS INT) AS j, CASE WHEN span >= 1 AND scale > 0 THEN {_narrow('top / sqrt(scale)', 3)} END AS correlation, CASE WHEN span >= 1 THEN {_narrow('conditional', 3)} END AS conditional, {_narrow('covered', 2)} AS coverage FROM st"""


@query("hmm_pairwise", _PAIRWISE)
def hmm_pairwise(spark, d):
    found = profile.count_reads(b.alignments(spark, d), b.references(spark), with_pairs=True)["pairs"]
    return found.select("tid", "i", "j", shown(F.col("correlation"), 3).alias("correlation"), shown(F.col("conditional"), 3).alias("conditional"), shown(F.col("coverage"), 2).alias("coverage"))


@query("profile_skeleton", f"""WITH {b.B1}, each_pos AS (SELECT tid, p AS pos, instr('ACGT', substr(seq, p + 1, 1)) - 1 AS base FROM refs, unnest(range(0, 120)) AS t(p)),
j AS (SELECT e.tid, e.pos, base, coalesce(coverage, 0) AS coverage, coalesce(spanned, 0) AS s, coalesce(mutations, 0) AS m FROM each_pos e LEFT JOIN pile USING (tid, pos))
SELECT CAST(tid AS INT) AS tid, CAST(pos AS INT) AS pos, CAST(base AS TINYINT) AS base, round(coverage, 3) AS coverage, CASE WHEN s > 0 AND s >= 1 THEN round(CAST(CAST(least(1.0, m / s) AS FLOAT) AS DOUBLE), 5) END AS reactivity,
CASE WHEN s > 0 AND s >= 1 THEN round(CAST(CAST(sqrt(least(1.0, m / s) * (1 - least(1.0, m / s)) / s) AS FLOAT) AS DOUBLE), 5) END AS error FROM j""")
def profile_skeleton(spark, d):
    found = profile.profile(b.references(spark), pileup(_mapped(spark, d).filter("accepted"), b.references(spark)))
    return found.select("tid", "pos", "base", F.round(F.col("coverage").cast("double"), 3).alias("coverage"), shown(F.col("reactivity"), 5).alias("reactivity"), shown(F.col("error"), 5).alias("error"))


@query("length_histogram", f"WITH {b.B1} SELECT CAST(tid AS INT) AS tid, CAST(n AS INT) AS length, count(*) AS n FROM mapped WHERE ok AND n <= 240 GROUP BY 1, 2")
def length_histogram(spark, d):
    return profile.length_histogram(_mapped(spark, d).filter("accepted"), b.REF_LEN)


@query("sequence_codes", f"WITH {b.B1}, c AS (SELECT CASE WHEN substr(seq, p + 1, 1) IN ('A', 'C', 'G', 'T') THEN instr('ACGT', substr(seq, p + 1, 1)) - 1 ELSE -1 END AS code FROM aln, unnest(range(0, n)) AS t(p)) SELECT CAST(code AS TINYINT) AS code, count(*) AS n FROM c GROUP BY 1")
def sequence_codes(spark, d):
    letters = b.alignments(spark, d).select(F.explode(F.split("seq", "")).alias("letter")).filter(F.length("letter") > 0)
    return letters.groupBy(scalars.base_code(F.col("letter")).alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("sequence_md5", f"WITH {b.B5} SELECT CAST(tid AS INT) AS tid, md5(upper(seq)) AS m5 FROM refs")
def sequence_md5(spark, d):
    return b.text_references(spark, d).select("tid", scalars.sequence_md5(F.col("seq")).alias("m5"))


@query("reference_mismatches", f"""WITH {b.B5}, d AS (SELECT f AS file_id, tid, name AS own_name, len AS own_len, CASE WHEN f = 1 AND tid % 7 = 2 THEN 'other' ELSE name END AS name, CASE WHEN f = 1 AND tid % 7 = 0 THEN len + 1 ELSE len END AS len,
CASE WHEN tid % 2 = 1 THEN upper(md5(seq)) WHEN f = 1 AND tid % 7 = 4 THEN md5('x') WHEN tid % 7 = 6 THEN 'abc' END AS m5, md5(upper(seq)) AS own FROM refs, unnest([0, 1]) AS t(f))
SELECT CAST(file_id AS INT) AS file_id, CAST(tid AS INT) AS tid, name, CASE WHEN len != own_len THEN 'length' WHEN name != own_name THEN 'name' ELSE 'checksum' END AS reason
FROM d WHERE len != own_len OR name != own_name OR (m5 IS NOT NULL AND lower(m5) != own)""")
def reference_mismatches(spark, d):
    """Two files that declare a reference for every document: one agrees but for checksums that are none, one errs by turns."""
    refs = b.text_references(spark, d)
    f, tid = F.col("file_id"), F.col("tid")
    m5 = F.when(tid % 2 == 1, F.upper(F.md5("seq"))).when((f == 1) & (tid % 7 == 4), F.md5(F.lit("x"))).when(tid % 7 == 6, "abc")
    each = refs.withColumn("file_id", F.explode(F.array(F.lit(0), F.lit(1))))
    declared = each.select("file_id", "tid", F.when((f == 1) & (tid % 7 == 2), "other").otherwise(F.col("name")).alias("name"), F.when((f == 1) & (tid % 7 == 0), F.col("len") + 1).otherwise(F.col("len")).cast("long").alias("len"), m5.alias("m5"))
    return verify.mismatches(declared, refs)


@query("union_inputs_twice", f"WITH {b.B1} SELECT CAST(tid AS INT) AS tid, CAST(pos AS INT) AS pos, round(2 * coverage, 4) AS coverage, round(2 * spanned, 4) AS spanned, round(2 * mutations, 4) AS mutations FROM pile")
def union_inputs_twice(spark, d):
    reads = _mapped(spark, d).filter("accepted")
    return _rounded_sums(pileup(reads.unionByName(reads), b.references(spark)))


@query("no_path_reads", f"WITH {b.B1} SELECT CAST(tid AS INT) AS tid, count(*) AS n FROM mapped WHERE rec_no IN (SELECT rec_no FROM lost) GROUP BY 1")
def no_path_reads(spark, d):
    return placed(_mapped(spark, d).filter("accepted"), b.references(spark)).filter("not has_path").groupBy("tid").agg(F.count(F.lit(1)).alias("n"))


_K = "CAST(tid AS INT) AS tid, CAST(pos AS INT) AS pos"


def _keys(df: DataFrame, *columns: Column) -> DataFrame:
    return df.select("tid", "pos", *columns)


# --- files, there and back --------------------------------------------------------------------------------------------------


def _plain_alignments(spark, d) -> DataFrame:
    """Letters that a line of SAM can hold."""
    return b.alignments(spark, d).withColumn("seq", F.regexp_replace("seq", "[^ACGT]", "N"))


@query("sam_round_trip", f"WITH {b.B1} SELECT CAST(tid AS INT) AS tid, CAST(pos AS BIGINT) AS pos, CAST(flag AS INT) AS flag, CAST(mapq AS SMALLINT) AS mapq, cigar, md5(regexp_replace(seq, '[^ACGT]', 'N', 'g')) AS seq_md5, repeat(chr(CAST(33 + q AS INT)), 3) AS qual_head, CAST(n AS INT) AS l_qseq, count(*) AS n FROM aln GROUP BY ALL")
def sam_round_trip(spark, d):
    path = written_text(text.sam_lines(_plain_alignments(spark, d), b.references(spark)), "sam")
    head = F.rpad(F.substring("qual", 1, 3), 3, F.substring("qual", 1, 1))
    read = text.read_sam(spark, path, require_sorted=True).select("tid", "pos", "flag", "mapq", "cigar", F.md5("seq").alias("seq_md5"), head.alias("qual_head"), "l_qseq")
    return read.groupBy(*read.columns).agg(F.count(F.lit(1)).alias("n"))


@query("sam_two_files", f"WITH {b.B1} SELECT CAST(f AS INT) AS file_id, CAST(tid AS INT) AS tid, count(*) AS n, CAST(sum(pos) AS BIGINT) AS pos_sum FROM aln, unnest([0, 1]) AS t(f) GROUP BY 1, 2")
def sam_two_files(spark, d):
    path = written_text(text.sam_lines(_plain_alignments(spark, d), b.references(spark)), "sam")
    return text.read_sam(spark, [path, path], with_numbers=False).groupBy("file_id", "tid").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("pos_sum"))


@query("sam_header", f"WITH {b.B1} SELECT 0 AS file_id, CAST(tid AS INT) AS tid, name, CAST(len AS BIGINT) AS len, md5(upper(seq)) AS m5, true AS is_sorted FROM refs")
def sam_header(spark, d):
    path = written_text(text.sam_lines(_plain_alignments(spark, d), b.references(spark)), "sam")
    return text.read_declared(spark, path).withColumn("is_sorted", F.lit(text.header_is_sorted(spark, path)))


@query("fasta_round_trip", f"WITH {b.B5} SELECT CAST(row_number() OVER (ORDER BY tid) - 1 AS INT) AS tid, name, comment, md5(seq) AS seq_md5, CAST(len AS INT) AS len FROM refs")
def fasta_round_trip(spark, d):
    """Whole documents as references, wrapped, in as many files as the sort made; numbered as they stand."""
    read = text.read_fasta(spark, written_text(text.fasta_lines(b.text_references(spark, d)), "fasta"))
    return read.select("tid", "name", "comment", F.md5("seq").alias("seq_md5"), "len")


@query("fasta_pieces", f"WITH {b.B5} SELECT CAST(row_number() OVER (ORDER BY tid) - 1 AS INT) AS tid, name, comment, CAST(len AS INT) AS len, md5(seq) AS m5 FROM refs")
def fasta_pieces(spark, d):
    """The same files read in pieces: one row a record from its first, and a checksum over all of them."""
    read = text.read_fasta_pieces(spark, written_text(text.fasta_lines(b.text_references(spark, d)), "fasta"))
    return pieces.heads(read).join(pieces.checksums(read), "tid")


@query("reference_stretches", f"WITH {b.B5} SELECT CAST(tid AS INT) AS tid, len // 3 AS stretch_from, md5(substr(seq, CAST(len // 3 + 1 AS BIGINT), CAST(len // (k + 1) + 1 AS BIGINT))) AS stretch_md5, CAST(len AS INT) AS ref_len FROM refs, unnest(range(0, 3)) AS t(k)")
def reference_stretches(spark, d):
    """Three reads of each reference from its first third on: as far as it goes, a half and a third of it."""
    refs = b.text_references(spark, d)
    reads = refs.select("tid", F.expr("bigint(len div 3)").alias("pos"), F.lit("").alias("seq"), F.lit("").alias("cigar"), "len", F.explode(F.array(*map(F.lit, range(3)))).alias("k"))
    found = with_stretch(reads, refs, F.col("pos"), F.expr("int(len div (k + 1)) + 1"))
    return found.select("tid", "stretch_from", F.md5("stretch").alias("stretch_md5"), "ref_len")


@query("structure_round_trip", f"SELECT 'ref' || {b.SQL_TID} AS name, string_agg(CASE WHEN quality IS NULL THEN '-' WHEN quality = 1 THEN '.' ELSE '(' END, '' ORDER BY doc_id) AS pairing FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def structure_round_trip(spark, d):
    marks = b.marks(spark, d).withColumn("name", F.concat(F.lit("ref"), F.col("tid").cast("string")))
    spelled = marks.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "mark"))), lambda x: x["mark"]), "").alias("pairing"))
    lines = spelled.select(F.concat(F.lit("> "), F.col("name"), F.lit(" a comment\nACGU\n"), F.col("pairing")).alias("value"))
    return text.read_structures(spark, written_text(lines, "structures"))


@query("run_round_trip", f"WITH {b.B2} SELECT {_K}, base, round(coverage, 6)::DOUBLE AS coverage, {sql_shown('reactivity')} AS reactivity, {sql_shown('error')} AS error, (SELECT count(DISTINCT tid) FROM treated) AS n_refs FROM treated")
def run_round_trip(spark, d):
    made = b.rates(spark, d, "R")
    run = made.agg(F.count_distinct("tid").cast("int").alias("n_refs")).select(F.lit("p").alias("program"), F.lit("1").alias("version"), "n_refs", F.lit(7).alias("cap"), F.lit(0).cast("bigint").alias("unmapped"), nan("float").alias("norm"))
    path = f"{own_dir(spark)}/run-{uuid.uuid4().hex}"
    for _ in range(2):  # the second replaces the first
        runs.write_run({"profile": made, "run": run}, path, overwrite=True)
    back = runs.read_run(spark, path, "div")
    rows = _keys(back["profile"], F.col("base"), F.col("coverage").cast("double").alias("coverage"), shown(F.col("reactivity")).alias("reactivity"), shown(F.col("error")).alias("error"))
    return rows.crossJoin(F.broadcast(back["run"].select(F.col("n_refs").cast("bigint").alias("n_refs"))))  # one row


@query("run_totals", f"WITH {b.B1} SELECT 'profilewright' AS program, CAST(4 AS INT) AS n_refs, CAST(120 AS INT) AS cap, count(*) FILTER (flag & 4 != 0) AS unmapped, true AS norm_is_nan FROM aln")
def run_totals(spark, d):
    return profile.run_table(b.references(spark), b.alignments(spark, d)).select("program", "n_refs", "cap", "unmapped", F.isnan("norm").alias("norm_is_nan"))


@query("dense_coverage", f"WITH {b.B1} SELECT CAST(r.tid AS INT) AS tid, CAST(p AS INT) AS pos, round(CASE WHEN p < 120 - 20 * r.tid THEN coalesce(coverage, 0) ELSE 0 END, 3) AS value FROM refs r, unnest(range(0, 120)) AS t(p) LEFT JOIN pile ON pile.tid = r.tid AND pile.pos = p")
def dense_coverage(spark, d):
    """Rows of references of unlike length, padded to the longest with the field's fill."""
    refs = b.references(spark)
    found = profile.profile(refs, pileup(_mapped(spark, d).filter("accepted"), refs)).filter("pos < 120 - 20 * tid")
    dense = profile.to_dense(found, refs, "coverage", FILLS["coverage"])
    return dense.select("tid", F.posexplode("values").alias("pos", "value")).select("tid", "pos", F.round(F.col("value").cast("double"), 3).alias("value"))


@query("sub_without_error", f"WITH {b.B2} SELECT {_K}, t.base, CAST(t.coverage + u.coverage AS BIGINT) AS coverage, {sql_shown('t.reactivity - u.reactivity')} AS reactivity, false AS has_error FROM treated t JOIN untreated u USING (tid, pos)")
def sub_without_error(spark, d):
    """A field that one input lacks is not carried."""
    made = combine.subtract(b.rates(spark, d, "R").drop("error"), b.rates(spark, d, "A"))
    return _keys(made, F.col("base"), F.col("coverage").cast("long").alias("coverage"), shown(F.col("reactivity")).alias("reactivity"), F.lit("error" in made.columns).alias("has_error"))


# --- profiles --------------------------------------------------------------------------------------------------------------


_SUB = f"{b.B2}, s AS (SELECT tid, pos, t.base, t.coverage + u.coverage AS coverage, t.reactivity - u.reactivity AS reactivity, CAST(sqrt(t.error * t.error + u.error * u.error) AS FLOAT) AS error FROM treated t JOIN untreated u USING (tid, pos))"


def _ratio(a: str) -> str:
    return f"""SELECT tid, pos, CASE WHEN NOT isnan(c.reactivity) AND c.reactivity > 0 THEN {a}.reactivity / c.reactivity ELSE CAST('NaN' AS FLOAT) END AS reactivity,
  CASE WHEN NOT isnan(c.reactivity) AND c.reactivity > 0 THEN CAST(sqrt({a}.error * {a}.error + ({a}.reactivity / c.reactivity * c.error) * ({a}.reactivity / c.reactivity * c.error)) AS FLOAT) / c.reactivity ELSE CAST('NaN' AS FLOAT) END AS error,
  {a}.coverage + c.coverage AS coverage FROM {a} JOIN control c USING (tid, pos)"""


@query("profile_rates", f"WITH {b.B2} SELECT {_K}, round(coverage, 6)::DOUBLE AS coverage, {sql_shown('reactivity')} AS reactivity, {sql_shown('error')} AS error FROM treated")
def profile_rates(spark, d):
    return _keys(b.rates(spark, d, "R"), F.col("coverage").cast("double").alias("coverage"), shown(F.col("reactivity")).alias("reactivity"), shown(F.col("error")).alias("error"))


@query("profile_min_depth", f"WITH {b.B2} SELECT {_K}, CASE WHEN spanned >= 900 THEN {sql_shown('reactivity')} END AS reactivity FROM treated")
def profile_min_depth(spark, d):
    return _keys(b.rates(spark, d, "R", 900.0), shown(F.col("reactivity")).alias("reactivity"))


@query("sub_reactivity", f"WITH {_SUB} SELECT {_K}, {sql_shown('reactivity')} AS reactivity FROM s")
def sub_reactivity(spark, d):
    return _keys(combine.subtract(b.rates(spark, d, "R"), b.rates(spark, d, "A")), shown(F.col("reactivity")).alias("reactivity"))


@query("sub_clip", f"WITH {_SUB} SELECT {_K}, {sql_shown('CASE WHEN reactivity < 0 THEN 0 ELSE reactivity END')} AS reactivity FROM s")
def sub_clip(spark, d):
    return _keys(combine.subtract(b.rates(spark, d, "R"), b.rates(spark, d, "A"), clip=True), shown(F.col("reactivity")).alias("reactivity"))


@query("sub_error", f"WITH {_SUB} SELECT {_K}, {sql_shown('error')} AS error FROM s")
def sub_error(spark, d):
    return _keys(combine.subtract(b.rates(spark, d, "R"), b.rates(spark, d, "A")), shown(F.col("error")).alias("error"))


@query("sub_counts", f"WITH {_SUB} SELECT {_K}, CAST(coverage AS BIGINT) AS coverage, base FROM s")
def sub_counts(spark, d):
    return _keys(combine.subtract(b.rates(spark, d, "R"), b.rates(spark, d, "A")), F.col("coverage").cast("long").alias("coverage"), F.col("base"))


@query("div_reactivity", f"WITH {b.B2}, q AS ({_ratio('treated')}) SELECT {_K}, {sql_shown('reactivity', 4)} AS reactivity FROM q")
def div_reactivity(spark, d):
    return _keys(combine.divide(b.rates(spark, d, "R"), b.rates(spark, d, "N")), shown(F.col("reactivity"), 4).alias("reactivity"))


@query("div_error", f"WITH {b.B2}, q AS ({_ratio('treated')}) SELECT {_K}, {sql_shown('error', 4)} AS error FROM q")
def div_error(spark, d):
    return _keys(combine.divide(b.rates(spark, d, "R"), b.rates(spark, d, "N")), shown(F.col("error"), 4).alias("error"))


@query("div_counts", f"WITH {b.B2}, q AS ({_ratio('treated')}) SELECT {_K}, CAST(coverage AS BIGINT) AS coverage FROM q")
def div_counts(spark, d):
    return _keys(combine.divide(b.rates(spark, d, "R"), b.rates(spark, d, "N")), F.col("coverage").cast("long").alias("coverage"))


@query("sub_then_div", f"WITH {_SUB}, q AS ({_ratio('s')}) SELECT {_K}, {sql_shown('reactivity', 4)} AS reactivity, {sql_shown('error', 4)} AS error, CAST(coverage AS BIGINT) AS coverage FROM q")
def sub_then_div(spark, d):
    less = combine.subtract(b.rates(spark, d, "R"), b.rates(spark, d, "A"))
    return _keys(combine.divide(less, b.rates(spark, d, "N")), shown(F.col("reactivity"), 4).alias("reactivity"), shown(F.col("error"), 4).alias("error"), F.col("coverage").cast("long").alias("coverage"))


@query("combine_same_mismatch", f"WITH {b.B2}, f AS (SELECT t.tid IS NULL OR u.tid IS NULL AS alone, t.base != CASE WHEN pos = 2 THEN -1 ELSE u.base END AS other FROM treated t FULL JOIN untreated u USING (tid, pos)) SELECT count(*) FILTER (alone) AS unmatched, count(*) FILTER (NOT alone AND other) AS different FROM f")
def combine_same_mismatch(spark, d):
    other = b.rates(spark, d, "A").withColumn("base", F.when(F.col("pos") == 2, -1).otherwise(F.col("base")).cast("tinyint"))
    return combine.disagreements(b.rates(spark, d, "R"), other)


@query("combine_add_counts", f"WITH {b.B2} SELECT CAST(tid AS INT) AS tid, CAST(sum(coverage) AS BIGINT) AS counted FROM (SELECT tid, coverage FROM treated UNION ALL SELECT tid, coverage FROM untreated) GROUP BY 1")
def combine_add_counts(spark, d):
    by_ref = [b.rates(spark, d, f).groupBy("tid").agg(F.sum("coverage").cast("long").alias("counted")) for f in "RA"]
    return combine.add_counts(*by_ref, ["tid"], ["counted"])


def _pool_sql(*names: str, floor: float | None = None) -> str:
    where = f"AND NOT isnan(coverage) AND coverage > {floor}" if floor is not None else ""
    return "p AS (" + " UNION ALL ".join(f"SELECT CAST(reactivity AS DOUBLE) AS rate FROM {n} WHERE isfinite(reactivity) {where}" for n in names) + ")"


_P90 = "coalesce(quantile_cont(rate, 0.9), 1.0)"


@query("norm_ubr_scale", f"WITH {b.B2}, {_pool_sql('treated', floor=2)} SELECT round({_P90}, 9) AS factor FROM p")
def norm_ubr_scale(spark, d):
    return normalize.scale_of([b.rates(spark, d, "R")], min_coverage=2).select(F.round("factor", 9).alias("factor"))


_BAND = "r AS (SELECT rate, row_number() OVER (ORDER BY rate DESC) - 1 AS k, count(*) OVER () AS n FROM p), f AS (SELECT coalesce(avg(rate) FILTER (k BETWEEN greatest(1, CAST(round(0.02 * n) AS BIGINT)) - 1 AND greatest(1, CAST(round(0.1 * n) AS BIGINT)) - 1), 1.0) AS factor FROM r)"


@query("norm_outlier_scale", f"WITH {b.B2}, {_pool_sql('treated')}, {_BAND} SELECT round(factor, 9) AS factor FROM f")
def norm_outlier_scale(spark, d):
    return normalize.scale_of([b.rates(spark, d, "R")], "outlier").select(F.round("factor", 9).alias("factor"))


@query("norm_pooled_inputs", f"WITH {b.B2}, {_pool_sql('treated', 'untreated', floor=2)} SELECT round({_P90}, 9) AS factor FROM p")
def norm_pooled_inputs(spark, d):
    return normalize.scale_of([b.rates(spark, d, "R"), b.rates(spark, d, "A")], min_coverage=2).select(F.round("factor", 9).alias("factor"))


@query("norm_apply", f"WITH {b.B2}, {_pool_sql('treated', floor=2)}, f AS (SELECT {_P90} AS factor FROM p) SELECT {_K}, {sql_shown('CAST(CAST(reactivity AS DOUBLE) / factor AS FLOAT)', 5)} AS reactivity, {sql_shown('CAST(CAST(error AS DOUBLE) / factor AS FLOAT)', 5)} AS error FROM treated, f")
def norm_apply(spark, d):
    (scaled,), _ = normalize.normalize([b.rates(spark, d, "R")], min_coverage=2)
    return _keys(scaled, shown(F.col("reactivity"), 5).alias("reactivity"), shown(F.col("error"), 5).alias("error"))


@query("norm_clip_above", f"WITH {b.B2}, {_pool_sql('control', floor=2)}, f AS (SELECT {_P90} AS factor FROM p), x AS (SELECT tid, pos, CAST(CAST(reactivity AS DOUBLE) / factor AS FLOAT) AS v FROM control, f) SELECT {_K}, {sql_shown('CASE WHEN NOT isnan(v) AND v > CAST(0.9 AS FLOAT) THEN CAST(0.9 AS FLOAT) ELSE v END', 5)} AS reactivity FROM x")
def norm_clip_above(spark, d):
    (scaled,), _ = normalize.normalize([b.rates(spark, d, "N")], min_coverage=2, clip_above=0.9)
    return _keys(scaled, shown(F.col("reactivity"), 5).alias("reactivity"))


@query("norm_unusable_scale", f"WITH {b.B2} SELECT true AS is_nan, count(*) AS unchanged FROM treated")
def norm_unusable_scale(spark, d):
    zero = b.rates(spark, d, "R").withColumn("reactivity", F.lit(0.0).cast("float"))
    (scaled,), norm = normalize.normalize([zero], min_coverage=2)
    return scaled.agg(F.count_if(F.col("reactivity") == 0).alias("unchanged")).crossJoin(norm).select(F.isnan("norm").alias("is_nan"), "unchanged")


@query("norm_empty_pool", "SELECT CAST(1.0 AS DOUBLE) AS norm")
def norm_empty_pool(spark, d):
    _, norm = normalize.normalize([b.rates(spark, d, "R")], min_coverage=1e9)
    return norm.select(F.col("norm").cast("double").alias("norm"))


# --- scores ----------------------------------------------------------------------------------------------------------------

_SCORE = f"""WITH {b.B3}, r AS (SELECT *, rank() OVER (PARTITION BY tid ORDER BY value) + (count(*) OVER (PARTITION BY tid, value) - 1) / 2.0 AS mid FROM pts),
v AS (SELECT tid, value, count(*) AS n, count(*) FILTER (open) AS o FROM pts GROUP BY 1, 2),
c AS (SELECT *, sum(o) OVER w AS found, sum(n) OVER w AS seen FROM v WINDOW w AS (PARTITION BY tid ORDER BY value DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
a AS (SELECT tid, count(*) FILTER (open) AS u, count(*) FILTER (NOT open) AS p, sum(mid) FILTER (open) AS ranks, avg(value) FILTER (open) AS mu, avg(value) FILTER (NOT open) AS mp FROM r GROUP BY 1),
m AS (SELECT a.*, (ranks - u * (u + 1) / 2.0) / (u * p) AS auroc, (SELECT sum(o * found / CAST(seen AS DOUBLE)) / u FROM c WHERE c.tid = a.tid) AS auprc FROM a WHERE u > 0 AND p > 0)"""


def _scores(spark, d) -> DataFrame:
    return score.metrics(score.points(*b.scored(spark, d)))


@query("score_auroc", f"{_SCORE} SELECT CAST(tid AS INT) AS tid, round(auroc, 6) AS auroc FROM m")
def score_auroc(spark, d):
    return _scores(spark, d).select("tid", F.round("auroc", 6).alias("auroc"))


@query("score_auprc", f"{_SCORE} SELECT CAST(tid AS INT) AS tid, round(auprc, 6) AS auprc FROM m")
def score_auprc(spark, d):
    return _scores(spark, d).select("tid", F.round("auprc", 6).alias("auprc"))


@query("score_means", f"{_SCORE} SELECT CAST(tid AS INT) AS tid, round(mp, 6) AS mean_paired, round(mu, 6) AS mean_unpaired FROM m")
def score_means(spark, d):
    return _scores(spark, d).select("tid", F.round("mean_paired", 6).alias("mean_paired"), F.round("mean_unpaired", 6).alias("mean_unpaired"))


@query("score_table", f"{_SCORE} SELECT 'ref' || tid AS name, p AS paired, u AS unpaired, printf('%.5f', auroc) AS auroc, printf('%.5f', auprc) AS auprc FROM m")
def score_table(spark, d):
    return score.as_csv_lines(score.score(*b.scored(spark, d))).select("name", "paired", "unpaired", "auroc", "auprc")


@query("score_ties_half", f"WITH {b.B3} SELECT CAST(tid AS INT) AS tid, 0.5::DOUBLE AS auroc FROM pts GROUP BY 1 HAVING count(*) FILTER (open) > 0 AND count(*) FILTER (NOT open) > 0")
def score_ties_half(spark, d):
    profile, refs, structures = b.scored(spark, d)
    level = profile.withColumn("reactivity", F.lit(1.0).cast("float"))
    return score.metrics(score.points(level, refs, structures)).select("tid", F.round("auroc", 6).alias("auroc"))


# --- pairs -----------------------------------------------------------------------------------------------------------------

_IJ = "CAST(tid AS INT) AS tid, CAST(i AS INT) AS i, CAST(j AS INT) AS j"
_CORR = '''CASE WHEN "left" * (span - "left") * "right" * (span - "right") > 0 THEN ("both" * span - "left" * "right") / sqrt("left" * (span - "left") * "right" * (span - "right")) END'''
_MIRROR = f"""st AS (SELECT tid, i, j, {_CORR} AS correlation, CASE WHEN "right" > 0 THEN "both" / "right" END AS conditional, span AS coverage FROM sums
UNION ALL SELECT tid, j, i, {_CORR}, CASE WHEN "left" > 0 THEN "both" / "left" END, span FROM sums WHERE i < j)"""


def _pair_sums(spark, d) -> DataFrame:
    return pairs.pair_sums(b.pair_events(spark, d))


@query("pairs_sums", f'WITH {b.B4} SELECT {_IJ}, span, "left", "right", "both", span AS covered FROM sums')
def pairs_sums(spark, d):
    return _pair_sums(spark, d).select("tid", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), *pairs.SUMS)


for _name, _digits in (("correlation", 5), ("conditional", 5), ("coverage", 3)):

    @query(f"pairs_{_name}", f"WITH {b.B4}, {_MIRROR} SELECT {_IJ}, round(CAST(CAST({_name} AS FLOAT) AS DOUBLE), {_digits}) AS {_name} FROM st")
    def _pair_statistic(spark, d, name=_name, digits=_digits):
        return pairs.statistics(_pair_sums(spark, d)).select("tid", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), shown(F.col(name), digits).alias(name))
