"""Scalar rules on bases, qualities and CIGAR strings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Model defaults, and the largest error a base can have.
OPEN_DELETION, OPEN_INSERTION, EXTEND_DELETION, EXTEND_INSERTION, MODIFICATION = 1e-3, 2e-4, 0.35, 0.35, 5e-3
WORST_ERROR = 0.75
#: Operations of a CIGAR whose lengths are summed one by one.
CHUNK = 64


def base_code(base: Column) -> Column:
    """A 0, C 1, G 2, T or U 3, in either case; else -1."""
    return (F.instr(F.lit("ACGT"), F.translate(F.upper(base), "U", "T")) - 1).cast("tinyint")


def sequence_md5(seq: Column) -> Column:
    return F.md5(F.upper(seq))


def same_digest(a: Column, b: Column) -> Column:
    """Digests agree in either case; one that is not 32 characters agrees with nothing."""
    return (F.lower(a) == F.lower(b)) & (F.length(a) == 32)


def phred_error(quality: Column, min_phred: int = 0) -> Column:
    """Error probability of a base: ``10 ** (-q / 10)``, 0.75 at most, and 0.75 below ``min_phred``; 0 without a quality."""
    own = F.least(F.lit(WORST_ERROR), F.pow(F.lit(10.0), -quality / F.lit(10.0)))
    return F.when(quality.isNull(), 0.0).when(quality < min_phred, WORST_ERROR).otherwise(own)


def agreement(error: Column, m: float = MODIFICATION) -> Column:
    return (1 - m) * (1 - error) + m * error / 3


def share_if_same(error: Column, m: float = MODIFICATION) -> Column:
    """Probability that a base that reads like its reference was modified."""
    return F.lit(m) * error / 3 / agreement(error, m)


def share_if_other(error: Column, m: float = MODIFICATION) -> Column:
    """Probability that a base that reads otherwise was modified."""
    half = m * (1 - error / 3) / 3
    return half / ((1 - m) * error / 3 + half)


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def cigar_ops(cigar: Column, pos: Column) -> Column:
    """A CIGAR's operations as ``struct(op, len, query, ref)``, with the query and reference positions at which each begins.

    Positions are summed within chunks of operations, and over the chunks before, so a read of thousands of operations is cut in
    little more than one pass.
    """
    pattern = F.lit("([0-9]+)([MIDNSHP=X])")
    lens, kinds = F.regexp_extract_all(cigar, pattern, F.lit(1)), F.regexp_extract_all(cigar, pattern, F.lit(2))
    parsed = F.transform(F.arrays_zip(lens.alias("len"), kinds.alias("op")), lambda o: F.struct(o["op"].alias("op"), o["len"].cast("int").alias("len")))
    chunk_of = lambda i: F.floor(i / CHUNK).cast("int")

    def moved(ops: Column, first: Column, n: Column, by: str) -> Column:
        return F.aggregate(F.slice(ops, first + 1, n), F.lit(0), lambda s, o: s + F.when(F.lit(by).contains(o["op"]), o["len"]).otherwise(0))

    def chunk_starts(ops: Column, by: str) -> Column:
        chunks = F.sequence(F.lit(0), chunk_of(F.size(ops)))
        return F.aggregate(chunks, F.array(F.lit(0)), lambda s, c: F.array_append(s, F.element_at(s, -1) + moved(ops, c * CHUNK, F.lit(CHUNK), by)))

    def placed(held: Column) -> Column:
        at = lambda i, by, starts: F.get(held[starts], chunk_of(i)) + moved(held["ops"], chunk_of(i) * CHUNK, i % CHUNK, by)
        return F.transform(held["ops"], lambda o, i: F.struct(o["op"].alias("op"), o["len"].alias("len"), at(i, "MIS=X", "q").alias("query"), (pos + at(i, "MDN=X", "r")).alias("ref")))

    return bound(parsed, lambda ops: bound(F.struct(ops.alias("ops"), chunk_starts(ops, "MIS=X").alias("q"), chunk_starts(ops, "MDN=X").alias("r")), placed))


def placed_length(cigar: Column, l_qseq: Column) -> Column:
    """Bases between the clips; 0 without a CIGAR."""
    # An empty string is told before the cast: failing casts are slow. So are these patterns: most reads have bases, and no clips.
    clip = lambda pattern: F.coalesce(F.nullif(F.regexp_extract(cigar, pattern, 1), F.lit("")).cast("int"), F.lit(0))
    all_clips = F.coalesce(cigar, F.lit("*")).rlike("^([0-9]+[SHP]|[0-9]+[DN])*$") | (F.coalesce(cigar, F.lit("*")) == "*")
    clips = F.when(F.instr(cigar, "S") == 0, 0).otherwise(clip("^(?:[0-9]+H)?([0-9]+)S") + clip("([0-9]+)S(?:[0-9]+H)?$"))
    return F.when(~F.coalesce(cigar, F.lit("*")).rlike("[MI=X]") & all_clips, 0).otherwise(l_qseq - clips)


def reference_span(cigar: Column) -> Column:
    """Reference bases a CIGAR covers."""
    pattern = F.lit("([0-9]+)[MDN=X]")
    return F.aggregate(F.regexp_extract_all(cigar, pattern, F.lit(1)), F.lit(0), lambda s, x: s + x.cast("int"))
