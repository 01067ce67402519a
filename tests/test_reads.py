"""Reads to profiles: sources, filters, placements and the model."""

import hashlib
import math
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from profilewright import joins
from profilewright.functions import scalars
from profilewright.operators import filters, hmm, profile, verify
from profilewright.operators.exact import exact_sum, halves
from profilewright.operators.pileup import contributions, is_tangled, pileup, placed, tallied
from profilewright.schema import ALIGNMENTS, REFERENCES
from profilewright.sources import bam, params, synthetic, text


def refs_of(spark, *seqs):
    return spark.createDataFrame([(i, f"ref{i}", None, s, len(s)) for i, s in enumerate(seqs)], REFERENCES)


def reads_of(spark, rows):
    """(tid, pos, flag, mapq, cigar, seq, qual)"""
    return spark.createDataFrame([(0, k, t, p, f, q, c, s, u, len(s or "")) for k, (t, p, f, q, c, s, u) in enumerate(rows)], ALIGNMENTS)


REF = "GATTACAGATTACACCGTGA"


def test_filters_follow_each_rule(spark):
    good = (0, 0, 0, 60, "5M", "GATTA", None)
    rows = [good, (0, 0, 256, 60, "5M", "GATTA", None), (0, 0, 2048, 60, "5M", "GATTA", None), (0, 0, 0, 255, "5M", "GATTA", None), (0, 0, 0, 19, "5M", "GATTA", None),
            (0, 0, 0, 60, "5M", None, None), (0, 0, 0, 60, "*", "GATTA", None), (0, 0, 0, 60, "5S", "GATTA", None), (0, 0, 16, 60, "5M", "GATTA", None)]
    ok = [r[0] for r in reads_of(spark, rows).orderBy("rec_no").select(filters.accepted(filters.ReadFilter())).collect()]
    assert ok == [True, False, True, False, False, False, False, False, True]
    forward = [r[0] for r in reads_of(spark, rows[-1:] + rows[:1]).orderBy("rec_no").select(filters.accepted(filters.ReadFilter(strands=frozenset({"forward"})))).collect()]
    assert forward == [False, True]
    with pytest.raises(ValueError):
        filters.ReadFilter(min_length=9, max_length=3)


def test_paired_reads_and_reads_without_reference_are_refused(spark):
    with pytest.raises(Exception, match="paired"):
        filters.refuse_paired(reads_of(spark, [(0, 0, 1, 60, "5M", "GATTA", None)])).collect()
    with pytest.raises(Exception, match="without a reference"):
        filters.mapped(reads_of(spark, [(-1, 0, 0, 60, "5M", "GATTA", None)])).collect()


def test_references_are_verified(spark):
    refs = refs_of(spark, REF)
    digest = hashlib.md5(REF.encode()).hexdigest()
    declared = lambda *row: spark.createDataFrame([row], "file_id int, tid int, name string, len bigint, m5 string")
    for row, reason in (((0, 0, "ref0", 20, digest.upper()), None), ((0, 0, "ref0", 20, None), None), ((0, 0, "x", 20, None), "name"), ((0, 0, "ref0", 21, None), "length"), ((0, 0, "ref0", 20, digest[:31]), "checksum"), ((0, 5, "ref0", 20, None), "missing")):
        assert [r["reason"] for r in verify.mismatches(declared(*row), refs).collect()] == ([reason] if reason else [])
    with pytest.raises(ValueError):
        verify.verify(declared(0, 0, "x", 20, None), refs)


CIGARS = ["10M", "4M2D6M", "4M3I3M", "2S8M", "4M2I1D4M", "4M1D2I4M", "3M1I1D6M", "2S3M2D2I3M", "4M3N6M", "3=2X5M", "2H8M2S"]


def random_read(rng, cigar, pos):
    n = sum(int(k) for k, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar) if op in "MIS=X")
    return (0, pos, 0, 60, cigar, "".join(rng.choice(list("ACGTN"), n)), "".join(chr(33 + int(q)) for q in rng.integers(2, 41, n)))


@pytest.mark.parametrize("weights", [(1.0, 1.0, 0.0), (0.5, 0.25, 1.0)])
def test_closed_form_is_the_model_without_a_band(spark, weights):
    rng = np.random.default_rng(5)
    reads = reads_of(spark, [random_read(rng, c, int(p)) for c in CIGARS for p in (0, 3, 9, 12)])
    refs = refs_of(spark, REF)
    closed = pileup(reads, refs, substitution=weights[0], deletion=weights[1], insertion=weights[2], min_phred=5)
    model = hmm.Model(substitution_weight=weights[0], deletion_weight=weights[1], insertion_weight=weights[2])
    parts = hmm.counts(reads, refs, band=0, model=model, min_phred=5).collect()
    a = {r["pos"]: (r["coverage"], r["spanned"], r["mutations"]) for r in closed.collect()}
    b = {}
    for r in parts:
        if r["kind"] == "pos":
            b[r["i"]] = b.get(r["i"], 0) + np.array([r["a"], r["b"], r["c"]])  # each task has its own sums
    assert a.keys() == b.keys() and len(a) > 10
    for pos in a:
        assert np.allclose(a[pos], b[pos], atol=1e-9), pos


def test_tangled_reads_are_told(spark):
    cases = {"10M": False, "4M2I1D4M": False, "4M1I1D1I4M": True, "2D2I5M": True, "5M2I2D": True, "3S1I1D5M": True, "4M1D1I1D3M": True, "5M2D": False}
    rows = spark.createDataFrame([(c,) for c in cases], "cigar string")
    from pyspark.sql import functions as F

    assert {r[0]: r[1] for r in rows.select("cigar", is_tangled(F.col("cigar"))).collect()} == cases


def window(cigar, ref, seq, band, pos=0, qual=None, bands=None, **weights):
    """One read alone through the arrays of the model."""
    columns = {"tid": [0], "pos": [pos], "kinds": [re.sub("[0-9]", "", cigar)], "lens": pa.array([[int(x) for x in re.findall("[0-9]+", cigar)]], pa.list_(pa.int32())), "seq": [seq], "qual": [qual or "I" * len(seq)], "stretch": [ref], "stretch_from": [0], "ref_len": [len(ref)]}
    if bands:
        columns["band"] = pa.array([bands], pa.list_(pa.int32()))
    reads = hmm.Reads(pa.RecordBatch.from_pydict(columns))
    batch = hmm.Batch(reads, np.array([0]), band, 0, hmm.Model(**weights).modification)
    out, path = hmm.posteriors(batch, hmm.Model(**weights))
    full = np.zeros((3, len(ref)))
    at = batch.origin[0] + np.arange(batch.window)
    ok = (at >= 0) & (at < len(ref))
    full[:, at[ok]] = out[:, 0, ok]
    return full, bool(path[0])


def brute_places(cigar, pos):
    """After each placed base, and before the first, the reference bases passed: before and after a deletion there. And the clipped bases at either end."""
    ops = [(int(n), op) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
    lead = tail = 0
    while ops and ops[0][1] in "SHP":
        n, op = ops.pop(0)
        lead += n * (op == "S")
    while ops and ops[-1][1] in "SHP":
        n, op = ops.pop()
        tail += n * (op == "S")
    first, last, at = [pos], [pos], pos
    for n, op in ops:
        for _ in range(n if op in "MI=X" else 0):
            at += op != "I"
            first.append(at), last.append(at)
        if op in "DN":
            at += n
            last[-1] = at
    return first, last, lead, tail


def brute_window(cigar, ref, seq, band, pos=0, qual=None, bands=None, model=None):
    """The recurrences cell by cell, in plain probabilities without scaling: three lists of sums by position, or None without a path."""
    model = model or hmm.Model()
    mi, md, ii, dd, mod = model.open_insertion, model.open_deletion, model.extend_insertion, model.extend_deletion, model.modification
    mm, im, dm = 1 - mi - md, 1 - ii, 1 - dd
    first, last, lead, tail = brute_places(cigar, pos)
    bases, quals = seq[lead : len(seq) - tail].upper().replace("U", "T"), (qual or "I" * len(seq))[lead : len(seq) - tail]
    n = len(bases)
    half = bands or [band] * (n + 1)
    cells = [range(f - h, s + h + 1) for f, s, h in zip(first, last, half)]

    def emission(i, j):
        if not 1 <= j <= len(ref):
            return 0.0, 0.0
        a, b, e = bases[i - 1], ref[j - 1].upper().replace("U", "T"), min(0.75, 10 ** (-(ord(quals[i - 1]) - 33) / 10))
        if a not in "ACGT" or b not in "ACGT":
            return 0.25, 0.0
        p = (1 - mod) * (1 - e) + mod * e / 3 if a == b else (1 - mod) * e / 3 + mod * (1 - e / 3) / 3
        return p, (mod * e / 3 if a == b else mod * (1 - e / 3) / 3) / p

    fm, fi, fd = {(0, j): 1 / len(cells[0]) for j in cells[0]}, {}, {}
    for i in range(1, n + 1):
        for j in cells[i]:
            fm[i, j] = emission(i, j)[0] * (mm * fm.get((i - 1, j - 1), 0) + im * fi.get((i - 1, j - 1), 0) + dm * fd.get((i - 1, j - 1), 0))
            fi[i, j] = 0.25 * (mi * fm.get((i - 1, j), 0) + ii * fi.get((i - 1, j), 0))
            fd[i, j] = md * fm[i, j - 1] + dd * fd[i, j - 1] if i < n and j > cells[i][0] else 0.0
    bm, bi, bd, step = {}, {}, {}, {}
    for i in range(n, -1, -1):
        for j in reversed(cells[i]):
            if i == n:
                bm[i, j], bi[i, j], bd[i, j] = 1.0, 1.0, 0.0
                continue
            p = emission(i + 1, j + 1)[0] * bm.get((i + 1, j + 1), 0) if j + 1 in cells[i + 1] else 0.0
            q = 0.25 * bi.get((i + 1, j), 0) if j in cells[i + 1] else 0.0
            after = bd.get((i, j + 1), 0.0) if i else 0.0
            bm[i, j], bi[i, j], bd[i, j], step[i, j] = mm * p + mi * q + md * after, im * p + ii * q, dm * p + dd * after if i else 0.0, p
    whole = sum(fm[0, j] * bm[0, j] for j in cells[0])
    if not whole:
        return None
    sums = np.zeros((3, len(ref) + 1))

    def add(k, at, x):
        if 0 <= at < len(ref):
            sums[k, at] += x / whole

    for i in range(1, n + 1):
        for j in cells[i]:
            match, gap = fm[i, j] * bm[i, j], fd[i, j] * bd[i, j]
            add(0, j - 1, match), add(1, j - 1, match + gap)
            add(2, j - 1, model.substitution_weight * match * emission(i, j)[1] + model.deletion_weight * dm * fd[i, j] * step.get((i, j), 0))
            opened = model.insertion_weight * mi * 0.25 * fm.get((i - 1, j), 0) * bi[i, j]
            add(1, j, opened), add(2, j, opened)
    return sums[:, :-1]


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_the_arrays_are_the_recurrences(data):
    """Any band, weights and awkward alignments, against the model cell by cell."""
    rng = np.random.default_rng(data.draw(st.integers(0, 9999)))
    cigar, band, pos = data.draw(st.sampled_from([*CIGARS, "2D5M3I", "3M2D1N4M", "1M1I1M1D1M", "5I5M", "10I", "3S4M3D2M1I3M2S"])), data.draw(st.integers(0, 4)), int(rng.integers(0, 14))
    _, _, _, _, _, seq, qual = random_read(rng, cigar, pos)
    ref = "".join(rng.choice(list("ACGTN"), 24, p=[0.24, 0.24, 0.24, 0.24, 0.04]))
    model = hmm.Model(0.01, 0.02, 0.4, 0.3, 0.01, 0.7, 0.6, 0.5)
    bands = [int(x) for x in rng.integers(0, 4, len(brute_places(cigar, pos)[0]))] if data.draw(st.booleans()) else None
    got, path = window(cigar, ref, seq, 0 if bands else band, pos, qual, bands, **vars(model))
    want = brute_window(cigar, ref, seq, band, pos, qual, bands, model)
    assert path == (want is not None)
    if path:
        assert np.allclose(got, want, atol=1e-9)


@pytest.mark.parametrize("bands", [None, "half"])
def test_counts_and_pairs_are_sums_of_windows(spark, bands, monkeypatch):
    """The whole job against the recurrences: sums by position, paths, and all pairs, in small squares."""
    monkeypatch.setattr(hmm, "SQUARE", 7)
    rng = np.random.default_rng(3)
    refs = [REF, "".join(rng.choice(list("ACGT"), 31))]
    rows = [(int(rng.integers(2)), *random_read(rng, c, int(p))[1:]) for c in [*CIGARS, "30M"] for p in (0, 2, 11)]
    halves = [[int(x) for x in rng.integers(0, 3, len(brute_places(r[4], r[1])[0]))] for r in rows]
    reads = reads_of(spark, rows).join(spark.createDataFrame(list(enumerate(halves)), "rec_no bigint, half array<int>"), "rec_no")
    parts = hmm.counts(reads.repartition(3), refs_of(spark, *refs), 2, pairs=True, bands=bands).collect()
    sums, pairs, status = {}, {}, {0: [0, 0], 1: [0, 0]}
    for (tid, pos, _, _, cigar, seq, qual), half in zip(rows, halves):
        w = brute_window(cigar, refs[tid], seq, 2, pos, qual, half if bands else None)
        status[tid][w is None] += 1
        if w is not None:
            at = np.flatnonzero(w[1] > 0)
            for i in at:
                sums[tid, i] = sums.get((tid, i), 0) + w[:, i]
                for j in at[at >= i]:
                    pairs[tid, i, j] = pairs.get((tid, i, j), 0) + np.array([w[1, i] * w[1, j], w[2, i] * w[1, j], w[1, i] * w[2, j], w[2, i] * w[2, j], w[0, i] * w[0, j]])
    got = {}
    for r in parts:
        if r["kind"] == "pair":
            got[r["tid"], r["i"], r["j"]] = got.get((r["tid"], r["i"], r["j"]), 0) + np.array([r[c] for c in "abcde"])
    assert got.keys() == pairs.keys() and all(np.allclose(got[k], pairs[k], atol=1e-9) for k in got) and len(got) > 200
    found = {}
    for r in parts:
        if r["kind"] == "pos":
            found[r["tid"], r["i"]] = found.get((r["tid"], r["i"]), 0) + np.array([r[c] for c in "abc"])
    assert found.keys() == sums.keys() and all(np.allclose(found[k], sums[k], atol=1e-9) for k in found)
    assert {t: [sum(r["a"] for r in parts if r["kind"] == "read" and r["tid"] == t), sum(r["b"] for r in parts if r["kind"] == "read" and r["tid"] == t)] for t in status} == status


@pytest.mark.parametrize("broadcast", [1 << 26, 0])
def test_reads_find_their_stretch_of_long_references(spark, broadcast, monkeypatch):
    monkeypatch.setattr(joins, "STRETCH", 8), monkeypatch.setattr(joins, "BROADCAST_BASES", broadcast)
    rng = np.random.default_rng(1)
    refs = ["".join(rng.choice(list("ACGT"), n)) for n in (1, 7, 8, 9, 40, 100)]
    rows = [(int(t), int(p), 0, 60, "5M", "GATTA", None) for t in range(7) for p in (0, 3, 7, 8, 15, 16, 39, 120)]
    for n in (1, 5, 8, 9, 30, 200):
        for r in joins.with_stretch(reads_of(spark, rows), refs_of(spark, *refs), F.col("pos") - 2, F.lit(n)).collect():
            ref, start = refs[r["tid"]] if r["tid"] < 6 else "", max(0, r["pos"] - 2)
            assert (r["stretch"], r["stretch_from"]) == (ref[start : start + n], start) and r["ref_len"] in (len(ref), 0 if start >= len(ref) else len(ref))


@pytest.mark.parametrize("run", [10, 30])
@pytest.mark.parametrize("gap", [1, 2, 3])
def test_gap_placements_in_a_homopolymer_agree_within_the_band(run, gap):
    ref = "GC" + "A" * run + "TG"
    seq = "GC" + "A" * (run - gap) + "TG"
    rows = [window(f"{k}M{gap}D{len(seq) - k}M", ref, seq, gap)[0] for k in range(2, run - gap + 3)]
    assert max(np.abs(r - rows[0]).max() for r in rows) < 1e-3
    assert abs(rows[0][0].sum() - len(seq)) < 0.05 * len(seq)
    narrow = [window(f"{k}M{gap}D{len(seq) - k}M", ref, seq, gap - 1)[0] for k in range(2, run - gap + 3)]
    assert max(np.abs(r - narrow[0]).max() for r in narrow) > 0.1


def test_worked_shares():
    full, path = window("4M", "ACGT", "ACGA", 0)
    assert path and np.allclose(full[0], 1) and np.allclose(full[2], [1.675209116353995e-07] * 3 + [0.9804876454438489], rtol=1e-9)
    assert window("5M", "ACGT", "ACGTA", 0)[1] is False


@settings(max_examples=30, deadline=None)
@given(st.data())
def test_weights_scale_what_they_weigh(data):
    rng = np.random.default_rng(data.draw(st.integers(0, 999)))
    ref = "".join(rng.choice(list("ACGT"), 40))
    cigar = data.draw(st.sampled_from(["20M", "8M2D12M", "8M3I9M"]))
    seq = "".join(rng.choice(list("ACGT"), 20))
    one, _ = window(cigar, ref, seq, 2, 5)
    half, _ = window(cigar, ref, seq, 2, 5, substitution_weight=0.5, deletion_weight=0.5)
    assert np.allclose(half[2], one[2] / 2) and np.allclose(half[:2], one[:2])
    assert (one[1] >= one[0] - 1e-12).all() and (one[2] <= one[1] + 1e-9).all()


def test_generated_reads_add_up(spark):
    o = synthetic.Options(references=6, length="60:90", reads="5:12", span="20:80", seed=3)
    refs, reads = synthetic.generate(spark, o)
    again = synthetic.generate(spark, o, tasks=3)
    assert sorted(map(tuple, reads.collect())) == sorted(map(tuple, again[1].collect()))
    run = profile.count_reads(reads, refs, with_pairs=True)
    total = run["ref_stats"].collect()
    assert sum(r["counted"] + r["rejected"] for r in total) == reads.filter("tid >= 0").count() > 0
    assert run["run"].first()["unmapped"] == 10
    rows = run["profile"].collect()
    assert len(rows) == sum(r["len"] for r in total)
    measured = [r for r in rows if not math.isnan(r["reactivity"])]
    assert measured and all(0 <= r["reactivity"] <= 1 for r in measured)
    assert {(r["i"], r["j"]) for r in run["pairs"].collect()} == {(r["j"], r["i"]) for r in run["pairs"].collect()}


def test_half_the_files_twice_is_all_of_them(spark):
    refs, reads = synthetic.generate(spark, synthetic.Options(references=2, length="50", reads="10", span="20:50", unmapped=0))
    sums = lambda r: {(x["tid"], x["pos"]): x["coverage"] for x in pileup(r, refs).collect()}
    one, two = sums(reads), sums(reads.unionByName(reads))
    assert one and all(abs(two[k] - 2 * v) < 1e-9 for k, v in one.items())


def test_sam_and_fasta_round_trip(spark, tmp_path):
    refs, reads = synthetic.generate(spark, synthetic.Options(references=3, length="70:130", reads="4", unmapped=2))
    text.fasta_lines(refs).coalesce(1).write.text(str(tmp_path / "fa"))
    text.sam_lines(reads, refs).coalesce(1).write.text(str(tmp_path / "sam"))
    back = text.read_fasta(spark, str(tmp_path / "fa"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, refs.collect()))
    assert text.header_is_sorted(spark, str(tmp_path / "sam"))
    assert not verify.mismatches(text.read_declared(spark, str(tmp_path / "sam")), back).head(1)
    keys = ["tid", "pos", "flag", "mapq", "cigar", "seq", "qual", "l_qseq"]
    mapped = lambda df: sorted(map(tuple, df.filter("flag & 4 = 0").select(*keys).collect()))
    assert mapped(text.read_sam(spark, str(tmp_path / "sam"), require_sorted=True)) == mapped(reads)


def test_bam_is_decoded(spark, tmp_path):
    seq, name = "ACGTN", b"r1\0"
    codes = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0]
    packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, 6, 2))
    body = struct.pack("<iiBBHHHi", 0, 7, len(name), 60, 0, 1, 16, 5) + struct.pack("<iii", -1, -1, 0) + name + struct.pack("<I", 5 << 4) + packed + bytes([30, 31, 32, 33, 34])
    data = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 3) + b"re\0" + struct.pack("<i", 50) + struct.pack("<i", len(body)) + body
    def member(x):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        return z.compress(x) + z.flush()
    head = b"@HD\tVN:1.6\tSO:coordinate\n@SQ\tSN:re\tLN:50\tM5:" + b"0" * 32 + b"\n"
    with_head = b"BAM\1" + struct.pack("<i", len(head)) + head + data[8:]
    (tmp_path / "h.bam").write_bytes(member(with_head) + member(b""))
    assert tuple(bam.read_declared(spark, str(tmp_path / "h.bam"), 3, require_sorted=True).first()) == (3, 0, "re", 50, "0" * 32)
    assert bam.read_bam(spark, str(tmp_path / "h.bam")).first()["seq"] == seq
    (tmp_path / "a.bam").write_bytes(member(data[:30]) + member(data[30:]) + member(b""))
    row = bam.read_bam(spark, str(tmp_path / "a.bam")).first()
    assert (row["tid"], row["pos"], row["flag"], row["mapq"], row["cigar"], row["seq"], row["qual"], row["l_qseq"]) == (0, 7, 16, 60, "5M", seq, "?@ABC", 5)
    assert tuple(bam.read_declared(spark, str(tmp_path / "a.bam")).first()) == (0, 0, "re", 50, None)
    with pytest.raises(ValueError, match="not sorted"):
        bam.read_declared(spark, str(tmp_path / "a.bam"), require_sorted=True)
    with pytest.raises(ValueError):
        bam.read_bam(spark, "x.cram")


def test_order_is_looked_at_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(filters, "ORDER_BLOCK", 3)
    rng = np.random.default_rng(4)
    for tids in (sorted(rng.integers(0, 5, 30)), rng.integers(0, 5, 30), [0, 1, 1, 0, 2, 2, 3, 3, 2]):
        flags = rng.choice([0, 4], len(tids), p=[0.8, 0.2])
        reads = reads_of(spark, [(int(t), 0, int(f), 60, "5M", "GATTA", None) for t, f in zip(tids, flags)])
        mapped = [int(t) for t, f in zip(tids, flags) if not f]
        backwards = sum(b < a for a, b in zip(mapped, mapped[1:]))
        assert filters.out_of_order(reads.repartition(3)).count() == backwards
        if backwards:
            with pytest.raises(ValueError):
                filters.refuse_disorder(reads)
        else:
            filters.refuse_disorder(reads)


def test_structures_are_read_and_refused(spark, tmp_path):
    (tmp_path / "ok").write_text("> one  more\nACGU\n.(.)\n>two\n....\n>three\nACGU\n")
    assert sorted(map(tuple, text.read_structures(spark, str(tmp_path / "ok")).collect())) == [("one", ".(.)"), ("two", "....")]
    for k, bad in enumerate((">a\n...\n...\n", "....\n>a\n...\n", ">a\n" + "." * 4096 + "\n")):
        (tmp_path / f"bad{k}").write_text(bad)
        with pytest.raises(Exception):
            text.read_structures(spark, str(tmp_path / f"bad{k}")).collect()


def test_parameters_round_trip_and_refuse():
    model = hmm.Model(open_deletion=0.25, modification=0.5)
    assert params.parse(params.dump(model)) == model
    assert params.parse("# none\n\ninsertion-open 0\n").open_insertion == 0
    for bad in ("deletion-open 1.5", "deletion-open -1", "speed 1", "deletion-open x", "deletion-open nan", "deletion-open 0.6\ninsertion-open 0.6"):
        with pytest.raises(ValueError):
            params.parse(bad)


def test_streaming_sums_equal_batch_sums(spark, tmp_path):
    """Over several files, tangled reads among them: as the model without a band counts all."""
    from profilewright.streaming import counts

    rng = np.random.default_rng(8)
    refs = refs_of(spark, REF * 3)
    reads = reads_of(spark, [random_read(rng, c, int(p)) for c in [*CIGARS, "4M1I1D1I4M", "3S1I1D5M", "5M2I2D"] for p in (0, 20, 40)])
    reads.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = counts.running_sums(counts.read_stream(spark, str(tmp_path / "in")), refs, min_phred=5)
    q = stream.writeStream.format("memory").queryName("sums").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {}
    for r in hmm.counts(reads, refs, 0, min_phred=5).filter("kind = 'pos'").collect():
        want[r["i"]] = want.get(r["i"], 0) + np.array([r["a"], r["b"], r["c"]])
    got = {r["pos"]: np.array([r["coverage"], r["spanned"], r["mutations"]]) for r in spark.table("sums").collect()}
    assert got.keys() == want.keys() and len(got) > 30 and all(np.allclose(got[k], want[k], atol=1e-9) for k in got)


def test_long_reads_have_thousands_of_operations(spark):
    """Positions past many chunks of operations, against a running sum."""
    rng = np.random.default_rng(6)
    rows = []
    for n in (1, 63, 64, 65, 128, 3000):
        ops = [(int(rng.integers(1, 9)), "MID=XSHPN"[int(rng.integers(0, 9))]) for _ in range(n)]
        rows.append(("".join(f"{k}{o}" for k, o in ops), n, ops))
    got = spark.createDataFrame([r[:2] for r in rows], "cigar string, pos long").select("pos", scalars.cigar_ops(F.col("cigar"), F.col("pos")).alias("ops")).collect()
    for (_, n, ops), r in zip(rows, sorted(got, key=lambda r: r["pos"]), strict=True):
        query, ref = 0, n
        for (k, o), x in zip(ops, r["ops"], strict=True):
            assert (x["op"], x["len"], x["query"], x["ref"]) == (o, k, query, ref)
            query, ref = query + k * (o in "MIS=X"), ref + k * (o in "MDN=X")


def test_sums_do_not_depend_on_order(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.random(4000) * 10.0 ** -rng.integers(0, 9, 4000), [0.0, 1.0, -0.25, 1e6 + 0.1]])
    sums = {spark.createDataFrame([(float(v),) for v in rng.permutation(x)], "v double").repartition(n).agg(exact_sum("v")).first()[0] for n in (1, 3, 8)}
    assert len(sums) == 1 and sums.pop() == pytest.approx(math.fsum(x), abs=len(x) * 2**-53, rel=1e-15)
    high, low = halves(x)
    assert np.abs(high + low - x).max() <= 2**-52 and len({float(high[rng.permutation(len(x))].sum()) for _ in range(9)}) == len({float(low[rng.permutation(len(x))].sum()) for _ in range(9)}) == 1
    assert spark.createDataFrame([], "v double").agg(exact_sum("v")).first()[0] is None


@pytest.mark.parametrize("band", [0, 2])
def test_profiles_are_bit_equal_however_reads_are_dealt(spark, band):
    refs, reads = synthetic.generate(spark, synthetic.Options(references=3, length="60:90", reads="40", unmapped=2))
    count = lambda r: profile.count_reads(r, refs, band=band)["profile"] if band else profile.count_along_alignments(r, refs)
    bits = lambda r: [(x["tid"], x["pos"], *(struct.pack("<d", x[c]) for c in ("coverage", "reactivity", "error"))) for x in count(r).orderBy("tid", "pos").collect()]
    found = [bits(reads.orderBy(F.rand(n)).repartition(n)) for n in (1, 4, 16)]
    assert found[0] == found[1] == found[2] and any(not math.isnan(struct.unpack("<d", x[3])[0]) for x in found[0])


def test_one_base_whose_quality_is_a_star_comes_back_from_sam(spark, tmp_path):
    rows = [(0, 0, 0, 60, "1M", "G", "*"), (0, 1, 0, 60, "1M", "A", None), (0, 2, 0, 60, "2M", "TT", "**"), (0, 3, 0, 60, "1M", None, "*"), (0, 4, 0, 60, "1M", "A", "I")]
    text.sam_lines(reads_of(spark, rows), refs_of(spark, REF)).write.text(str(tmp_path / "sam"))
    back = text.read_sam(spark, str(tmp_path / "sam")).orderBy("pos").select("seq", "qual").collect()
    assert [tuple(r) for r in back] == [("G", "*"), ("A", None), ("TT", "**"), (None, None), ("A", "I")]
    (tmp_path / "foreign").write_text("@HD\tVN:1.6\n@SQ\tSN:ref0\tLN:20\nr\t0\tref0\t1\t60\t1M\t*\t0\t0\tG\t*\tNM:i:0\n")
    assert text.read_sam(spark, str(tmp_path / "foreign")).first()["qual"] is None


@pytest.mark.parametrize("options", [{}, {"substitution": 0.5, "deletion": 2.0, "insertion": 0.25, "min_phred": 9}])
def test_pileup_on_arrays_sends_a_few_rows_a_position_and_sums_what_its_rows_do(spark, options):
    refs, cigars = refs_of(spark, REF, REF[::-1]), ["8M", "3M2D3M", "2M1I5M", "2S4M1H", "2M2I1D4M", "2M1D2I4M", "3D5M2D", "1M1D1D6M", "8M", "*"]
    rows = [(k % 2, (3 * k) % 14 - 1, 0, 60, c, "GATuACNG"[: 6 if "S" in c else 8], None if k % 5 == 0 else "I#%&~+!H"[: 6 if "S" in c else 8]) for k, c in enumerate(cigars * 40)]
    rows += [(0, 2, 0, 60, c, "", "") for c in ("", "5S")]
    reads = reads_of(spark, rows)
    names = ["tid", "pos", "coverage", "spanned", "mutations"]
    one_by_one = contributions(placed(reads, refs), **options).groupBy("tid", "pos").agg(*(exact_sum(c).alias(c) for c in names[2:]))
    told = lambda df: {tuple(r[:2]): tuple(r[2:]) for r in df.select(*names).collect()}
    want, got = told(one_by_one), told(pileup(reads, refs, **options))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    made = next(tallied(**options)([joins.with_stretch(reads, refs, F.col("pos"), scalars.reference_span(F.col("cigar")) + 1).toArrow().combine_chunks().to_batches()[0]]))
    assert made.num_rows <= len(want)


def test_reads_of_a_batch_that_move_alike_stand_together_and_equal_reads_alone(monkeypatch):
    cigars = ["8M", "3M2I3M", "2M2D6M", "8M"] * 6
    columns = {"tid": [0] * 24, "pos": [k % 5 for k in range(24)], "kinds": [re.sub("[0-9]", "", c) for c in cigars], "lens": pa.array([[int(x) for x in re.findall("[0-9]+", c)] for c in cigars], pa.list_(pa.int32())),
               "seq": ["GATTACAG"] * 24, "qual": ["I5#IIII+"] * 24, "stretch": [REF] * 24, "stretch_from": [0] * 24, "ref_len": [len(REF)] * 24}
    reads, model = hmm.Reads(pa.RecordBatch.from_pydict(columns)), hmm.Model(insertion_weight=0.5)
    (chosen,) = reads.batches(2)
    shapes = [cigars[k] for k in chosen]
    assert sum(a != b for a, b in zip(shapes, shapes[1:], strict=False)) == 2
    batch = hmm.Batch(reads, chosen, 2, 0, model.modification)
    together, paths = hmm.posteriors(batch, model)
    for k, read in enumerate(chosen):
        one = hmm.Batch(reads, np.array([read]), 2, 0, model.modification)
        alone, path = hmm.posteriors(one, model)
        assert path[0] == paths[k] and one.origin[0] == batch.origin[k]
        assert (alone[:, 0] == together[:, k, : one.window]).all() and not together[:, k, one.window :].any()


def test_a_sam_file_given_twice_is_parsed_once_and_counts_twice(spark, tmp_path):
    refs, reads = synthetic.generate(spark, synthetic.Options(references=30, length="70:130", reads="4", unmapped=2))
    path, other = str(tmp_path / "sam"), str(tmp_path / "other")
    text.sam_lines(reads, refs).repartitionByRange(5, F.col("value").startswith("@").cast("int") * -1, F.substring("value", 1, 1)).write.text(path)
    text.sam_lines(reads.filter("tid < 3"), refs).coalesce(1).write.text(other)
    back = text.read_sam(spark, [path, other, path], with_numbers=False)
    assert "rec_no" not in back.columns
    assert back._jdf.queryExecution().executedPlan().toString().count("FileScan text") == 2
    by_file = lambda df, f: sorted(map(tuple, df.filter(F.col("file_id") == f).select("tid", "pos", "flag", "mapq", "cigar", "seq", "qual").collect()))
    whole = text.read_sam(spark, path)
    assert by_file(back, 0) == by_file(back, 2) == by_file(whole, 0) and len(by_file(back, 0)) == reads.count()
    assert len(by_file(back, 1)) == reads.filter("tid < 3").count()
    assert sorted(r[0] for r in whole.select("rec_no").collect()) == list(range(reads.count()))
    names = {r["name"]: r["tid"] for r in text.read_declared(spark, path, 4).collect()}
    assert sorted(names.values()) == list(range(30)) and len(names) == 30
