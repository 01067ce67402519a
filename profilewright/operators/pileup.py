"""Counting reads along their own alignment: the model with a band of nothing, where it has a closed form that Catalyst can run."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.scalars import cigar_ops, reference_span
from ..joins import ascii_only, with_stretch
from .arrays import CODE, by_position, kind, ragged, strings
from .exact import exact_sum


_GAP = "DN"
_TOUCHING = "I[0-9]+[DN]|[DN][0-9]+I"
#: Where an insertion and a deletion touch at an end, or three such operations follow each other, several paths may be open.
_TANGLED = "I[0-9]+[DN][0-9]+I|[DN][0-9]+I[0-9]+[DN]|^([0-9]+[SHP])*[0-9]+([DN][0-9]+I|I[0-9]+[DN])|(I[0-9]+[DN]|[DN][0-9]+I)([0-9]+[SHP])*$"


def is_tangled(cigar: Column) -> Column:
    return cigar.rlike(_TANGLED)


def only_path(ops: Column) -> Column:
    """The operations of the one path that a band of nothing leaves: a read cannot go between insertion and deletion, so where the two touch, one base of each becomes a match."""
    def op(o, kind, length, query, ref):
        return F.struct(F.lit(kind).alias("op") if isinstance(kind, str) else kind.alias("op"), length.cast("int").alias("len"), query.cast("int").alias("query"), ref.cast("bigint").alias("ref"))

    def rewritten(o, i):
        before, after = F.get(ops, i - 1)["op"], F.get(ops, i + 1)["op"]
        is_in, is_gap = o["op"] == "I", F.lit(_GAP).contains(o["op"])
        next_gap, last_gap = F.coalesce(F.lit(_GAP).contains(after), F.lit(False)), F.coalesce(F.lit(_GAP).contains(before), F.lit(False))
        n, q, r, one = o["len"], o["query"], o["ref"], F.lit(1)
        return (
            F.when(is_in & next_gap, F.array(op(o, "I", n - 1, q, r), op(o, "M", one, q + n - 1, r)))
            .when(is_in & last_gap, F.array(op(o, "I", n - 1, q + 1, r)))
            .when(is_gap & (before == "I"), F.array(op(o, o["op"], n - 1, q, r + 1)))
            .when(is_gap & (after == "I"), F.array(op(o, o["op"], n - 1, q, r), op(o, "M", one, q, r + n - 1)))
            .otherwise(F.array(op(o, o["op"], n, q, r)))
        )

    return F.filter(F.flatten(F.transform(ops, rewritten)), lambda o: o["len"] > 0)


def placed(reads: DataFrame, references: DataFrame) -> DataFrame:
    """Accepted reads with the operations of their path, the stretch of their reference under it, and whether the path is inside the reference. Tangled reads are for the model itself."""
    plain = reads.filter(~is_tangled(F.col("cigar"))).select("tid", "pos", "cigar", "seq", "qual")
    # The path of touching operations is no longer than their alignment and one base.
    joined = with_stretch(plain, references, F.col("pos"), reference_span(F.col("cigar")) + 1)
    # A generator of one row keeps the parsed operations from being computed again for each use.
    ops = joined.withColumn("own_ops", F.explode(F.array(cigar_ops(F.col("cigar"), F.col("pos")))))
    ops = ops.withColumn("ops", F.explode(F.array(F.when(F.col("cigar").rlike(_TOUCHING), only_path(F.col("own_ops"))).otherwise(F.transform("own_ops", lambda o: F.struct(o["op"].alias("op"), o["len"].cast("int").alias("len"), o["query"].cast("int").alias("query"), o["ref"].cast("bigint").alias("ref"))))))).drop("own_ops")
    outside = F.exists("ops", lambda o: F.lit("M=X").contains(o["op"]) & ((o["ref"] < 0) | (o["ref"] + o["len"] > F.col("ref_len"))))
    return ops.withColumn("has_path", ~outside)


def shares(min_phred: int, modification: float) -> tuple[list[float], list[float]]:
    """By quality, 0-222, and last without one: the chance that a base was modified, if it reads like its reference, and if not."""
    errors = [scalars.WORST_ERROR if q < min_phred else min(scalars.WORST_ERROR, 10 ** (-q / 10)) for q in range(223)] + [0.0]
    m = modification
    same = [(1 - m) * (1 - e) + m * e / 3 for e in errors]
    other = [(1 - m) * e / 3 + m * (1 - e / 3) / 3 for e in errors]
    return [m * e / 3 / s if s else 0.0 for e, s in zip(errors, same, strict=True)], [m * (1 - e / 3) / 3 / o if o else 0.0 for e, o in zip(errors, other, strict=True)]


def contributions(reads: DataFrame, substitution: float = 1.0, deletion: float = 1.0, insertion: float = 0.0, min_phred: int = 0, modification: float = scalars.MODIFICATION) -> DataFrame:
    """``tid, pos, coverage, spanned, mutations`` of each base of ``placed`` reads that have a path.

    A base counts 1 for coverage and span and its chance of a modification; each base of a deletion counts for span, its last
    as a mutation; an insertion counts, by its weight, for the base after it. Deletions at the ends count for nothing.
    An operation's letters are cut out of read, reference and qualities as three lists and generated together, so a generated row
    holds three letters.
    """
    op, n = F.col("o.op"), F.col("o.len")
    is_placed = F.transform("ops", lambda o: F.lit("MI=X").contains(o["op"]))
    ends = {"first_placed": F.array_position(is_placed, True) - 1, "last_placed": F.size("ops") - F.array_position(F.reverse(is_placed), True)}
    each = reads.filter("has_path").withColumns(ends).select("tid", "ref_len", "seq", "qual", "stretch", "stretch_from", "first_placed", "last_placed", F.posexplode("ops").alias("at", "o"))
    between = (F.col("first_placed") >= 0) & F.col("at").between(F.col("first_placed") + 1, F.col("last_placed") - 1)
    is_base, is_gap = op.isin("M", "=", "X"), op.isin("D", "N")
    cut = lambda text, begin: F.substring(text, (begin + 1).cast("int"), n)
    letters = lambda text: F.split(F.translate(text, "acgtuU", "ACGTTT"), "")
    spelled = F.arrays_zip(
        letters(cut(F.col("seq"), F.col("o.query"))).alias("read"), letters(cut(F.col("stretch"), F.col("o.ref") - F.col("stretch_from"))).alias("ref"),
        F.split(F.coalesce(cut(F.col("qual"), F.col("o.query")), F.lit("")), "").alias("qual"),
    )
    nothing = F.struct(*(F.lit(None).cast("string").alias(c) for c in ("read", "ref", "qual")))
    kept = each.filter(is_base | (is_gap & between) | ((op == "I") & F.lit(insertion > 0)))
    bases = kept.select(
        "tid", "ref_len", F.col("o.ref").alias("ref"), n.alias("n"), is_base.alias("is_base"), is_gap.alias("is_gap"),
        F.posexplode(F.when(is_base, spelled).otherwise(F.array_repeat(nothing, F.when(is_gap, n).otherwise(1)))).alias("k", "b"),
    ).filter((F.col("k") < F.col("n")) | ~F.col("is_base"))
    pos = (F.col("ref") + F.col("k")).cast("int")
    same, other = (F.array(*map(F.lit, table)) for table in shares(min_phred, modification))
    quality = F.when(F.coalesce(F.col("b.qual"), F.lit("")) == "", 223).otherwise(F.least(F.ascii("b.qual") - 33, F.lit(222)))
    known = F.col("b.read").isin(*"ACGT") & F.col("b.ref").isin(*"ACGT")
    share = F.when(~known, 0.0).when(F.col("b.read") == F.col("b.ref"), F.get(same, quality)).otherwise(F.get(other, quality))
    named = bases.select("tid", pos.alias("pos"), "ref_len", "is_base", "is_gap", (F.col("k") == F.col("n") - 1).alias("is_last"), share.alias("share"))
    return named.filter((F.col("pos") >= 0) & (F.col("pos") < F.col("ref_len"))).select(
        "tid", "pos",
        F.when(F.col("is_base"), 1.0).otherwise(0.0).alias("coverage"),
        F.when(F.col("is_base") | F.col("is_gap"), 1.0).otherwise(insertion).alias("spanned"),
        F.when(F.col("is_base"), substitution * F.col("share")).when(F.col("is_gap"), F.when(F.col("is_last"), deletion).otherwise(0.0)).otherwise(insertion).alias("mutations"),
    )


_MATCH, _GAPS, _KNOWN = kind("M=X"), kind(_GAP), kind("MIDNSHP=X")
#: Bases of the reads of a batch that are looked at together.
BASES_AT_ONCE = 1 << 20


def operations(cigars: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of CIGARs in one run of bytes, each from its place in ``at`` on: the read, kind and length of each operation."""
    text = cigars[at[0] : at[-1]]
    digit = (text >= ord("0")) & (text <= ord("9"))
    end = np.flatnonzero(~digit)
    begin = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
    size = np.zeros(len(end), np.int64)
    for back in range(1, int((end - begin).max(initial=0)) + 1):
        more = np.flatnonzero(end - back >= begin)
        size[more] += (text[end[more] - back].astype(np.int64) - ord("0")) * 10 ** (back - 1)
    owner = np.searchsorted(at - at[0], end, side="right") - 1
    ok = _KNOWN[text[end]] & (end > begin)
    return owner[ok], text[end[ok]], size[ok]


def _before(x: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """What the earlier operations of the same read sum to."""
    upto = np.cumsum(x) - x
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    return upto - np.repeat(upto[first], np.diff(first, append=len(x)))


def _paths(owner: np.ndarray, op: np.ndarray, size: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
    """As ``only_path``, for all operations together: the read, kind, length, and the places in read and reference, of those with a length."""
    is_in, is_gap = op == ord("I"), _GAPS[op]
    query, ref = _before(np.where(_MATCH[op] | is_in | (op == ord("S")), size, 0), owner), pos[owner] + _before(np.where(_MATCH[op] | is_gap, size, 0), owner)
    same = owner[1:] == owner[:-1]
    after = lambda x: np.append(x[1:] & same, False)
    ahead = lambda x: np.concatenate([[False], x[:-1] & same]) if len(x) else x
    opens, closes = is_in & after(is_gap), is_in & ahead(is_gap) & ~after(is_gap)
    follows, leads = is_gap & ahead(is_in), is_gap & after(is_in) & ~ahead(is_in)
    extra = np.flatnonzero(opens | leads)
    made_query, made_ref = query[extra] + np.where(opens[extra], size[extra] - 1, 0), ref[extra] + np.where(leads[extra], size[extra] - 1, 0)
    cut = opens | closes | follows | leads
    order = np.argsort(np.concatenate([np.arange(len(op)), extra]), kind="stable")
    whole = lambda x, more: np.concatenate([x, more])[order]
    found = whole(owner, owner[extra]), whole(op, np.full(len(extra), ord("M"), np.uint8)), whole(size - cut, np.ones(len(extra), np.int64)), whole(query + closes, made_query), whole(ref + follows, made_ref)
    return tuple(x[found[2] > 0] for x in found)


def tallied(substitution: float = 1.0, deletion: float = 1.0, insertion: float = 0.0, min_phred: int = 0, modification: float = scalars.MODIFICATION) -> Callable:
    """What ``contributions`` of ``placed`` sums to, on Arrow batches of reads with their stretches: by batch, in two rows a position that add up exactly."""
    same, other = (np.array(x) for x in shares(min_phred, modification))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tid, pos, stretch_from, ref_len = (np.asarray(batch.column(c), np.int64) for c in ("tid", "pos", "stretch_from", "ref_len"))
            (cigars, cigar_at), (seq, seq_at), (qual, qual_at), (stretch, stretch_at) = (strings(batch.column(c)) for c in ("cigar", "seq", "qual", "stretch"))
            owner, op, size, query, ref = _paths(*operations(cigars, cigar_at), pos)
            n, place = len(tid), np.arange(len(op))
            lost = np.zeros(n, bool)
            lost[owner[_MATCH[op] & ((ref < 0) | (ref + size > ref_len[owner]))]] = True
            is_placed = np.flatnonzero(_MATCH[op] | (op == ord("I")))
            first, last = np.full(n, len(op)), np.full(n, -1)
            np.minimum.at(first, owner[is_placed], is_placed)
            np.maximum.at(last, owner[is_placed], is_placed)
            between = (place > first[owner]) & (place < last[owner])
            count = np.where(_MATCH[op] | (_GAPS[op] & between), size, 0) + ((op == ord("I")) & (insertion > 0))
            kept = np.flatnonzero((count > 0) & ~lost[owner])
            upto, i, held = np.cumsum(count[kept]), 0, []
            while i < len(kept):
                j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + BASES_AT_ONCE, side="right")))
                chosen, i = kept[i:j], j
                row, k = ragged(np.zeros(len(chosen), np.int64), count[chosen])
                o = chosen[row]
                read, at = owner[o], ref[o] + k
                is_base, is_gap = _MATCH[op[o]], _GAPS[op[o]]
                bases = np.flatnonzero(is_base)
                own = read[bases]

                def looked_up(values: np.ndarray, begins: np.ndarray, where: np.ndarray, own=own) -> np.ndarray:
                    inside = (where >= 0) & (where < begins[own + 1] - begins[own])
                    return np.append(values, np.uint8(0))[np.where(inside, begins[own] + where, len(values))]

                letter = query[o[bases]] + k[bases]
                mine, theirs = CODE[looked_up(seq, seq_at, letter)], CODE[looked_up(stretch, stretch_at, at[bases] - stretch_from[own])]
                quality = looked_up(qual, qual_at, letter).astype(np.int64)
                quality = np.where(quality == 0, 223, np.clip(quality - 33, 0, 222))
                share = np.where((mine < 0) | (theirs < 0), 0.0, np.where(mine == theirs, same[quality], other[quality]))
                spanned = np.where(is_base | is_gap, 1.0, insertion)
                mutations = np.where(is_gap, np.where(k == size[o] - 1, deletion, 0.0), insertion)
                mutations[bases] = substitution * share
                inside = (at >= 0) & (at < ref_len[read])
                held.append((tid[read[inside]], at[inside], is_base[inside].astype(float), spanned[inside], mutations[inside]))
                if i < len(kept):  # a batch of long reads
                    yield from _sums(held)
                    held = []
            if held:
                yield from _sums(held)

    return rows


def _sums(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    tid, at, *values = (np.concatenate(x) for x in zip(*held, strict=True))
    tids, places, parts = by_position(tid, at, values)
    for half in (0, 1):
        yield pa.RecordBatch.from_arrays([pa.array(tids, pa.int32()), pa.array(places, pa.int32()), *(pa.array(x) for x in parts[half::2])], names=["tid", "pos", "coverage", "spanned", "mutations"])


def pileup(reads: DataFrame, references: DataFrame, **options) -> DataFrame:
    """``tid, pos`` and the sums of what accepted reads contribute, tangled ones apart, as ``contributions`` has them. A task sums its batches as arrays, so a few rows a position are shuffled and one deep reference is no hot group."""
    plain = reads.filter(~is_tangled(F.col("cigar"))).select("tid", "pos", "cigar", ascii_only(F.col("seq"), "N").alias("seq"), ascii_only(F.col("qual"), "~").alias("qual"))
    sent = with_stretch(plain, references, F.col("pos"), reference_span(F.col("cigar")) + 1)
    parts = sent.mapInArrow(tallied(**options), "tid int, pos int, coverage double, spanned double, mutations double")
    return parts.groupBy("tid", "pos").agg(*(exact_sum(c).alias(c) for c in ("coverage", "spanned", "mutations")))
