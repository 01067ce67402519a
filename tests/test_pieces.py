"""Long references in pieces: read, checked, cut for reads, and counted as whole ones are."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from profilewright import joins, pieces
from profilewright.operators import profile, verify
from profilewright.schema import ALIGNMENTS
from profilewright.sources import synthetic, text


def records(df):
    """Bases of each reference, put together; pieces must meet."""
    found = {}
    for r in sorted(df.collect(), key=lambda r: (r["tid"], r["from_base"])):
        name, comment, n, seq = found.get(r["tid"], (r["name"], r["comment"], r["len"], ""))
        assert (name, comment, n, len(seq)) == (r["name"], r["comment"], r["len"], r["from_base"]) and len(r["bases"]) <= text.PIECE
        found[r["tid"]] = name, comment, n, seq + r["bases"]
    assert all(n == len(seq) for _, _, n, seq in found.values())
    return found


@pytest.fixture
def small_splits(spark, monkeypatch):
    """Splits of so many bytes while the text is read, and not of what is written then."""
    names = [f"spark.sql.files.{c}" for c in ("maxPartitionBytes", "openCostInBytes")]
    written = text.materialize

    def materialize(df, name):
        found = written(df, name)
        if name == "fasta-pieces":
            [spark.conf.unset(c) for c in names]
        return found

    def use(n):
        spark.conf.set(names[0], n), spark.conf.set(names[1], 1)

    monkeypatch.setattr(text, "materialize", materialize)
    yield use
    [spark.conf.unset(c) for c in names]


@pytest.mark.parametrize("split", [23, 150, 1 << 27])
def test_records_go_on_from_split_to_split(spark, tmp_path, small_splits, split):
    rng = np.random.default_rng(split)
    made, folder = [], tmp_path / "fa"
    folder.mkdir()
    for f in range(3):
        lines = ["ignored before a name"] if f == 1 else []
        for k in range(4 if f < 2 else 0):
            seq = "".join(rng.choice(list("ACGTNacgtu"), int(rng.choice([0, 1, 9, 60, 200]))))
            comment = [None, "of several words", "x"][k % 3]
            made.append((f"r{f}.{k}", comment, len(seq), seq))
            lines += [f">r{f}.{k}" + (f" {comment}" if comment else "")] + [seq[i : i + 11] + (" \r" if i % 2 else "") for i in range(0, len(seq), 11)] + [""] * (k % 2)
        (folder / f"{f}.fa").write_text("\n".join(lines) + ("\n" if f else ""))
    small_splits(split)
    got = text.read_fasta_pieces(spark, str(folder))
    assert records(got) == dict(enumerate(made))
    assert {r["tid"]: r["m5"] for r in pieces.checksums(got).collect()} == {t: hashlib.md5(m[3].upper().encode()).hexdigest() for t, m in enumerate(made)}
    assert sorted(map(tuple, pieces.heads(got).collect())) == [(t, *m[:3]) for t, m in enumerate(made)]


def test_a_long_record_has_bounded_rows(spark, tmp_path, small_splits):
    rng = np.random.default_rng(4)
    long, short = ("".join(rng.choice(list("ACGT"), n)) for n in (700_001, 5))
    one_line = "".join(rng.choice(list("ACGT"), 200_000))
    path = tmp_path / "long.fa"
    path.write_text(">long\n" + "\n".join(long[i : i + 60] for i in range(0, len(long), 60)) + f"\n>short\n{short}\n>line\n{one_line}")
    small_splits(100_000)
    got = text.read_fasta_pieces(spark, str(path))
    assert {v[0]: v[3] for v in records(got).values()} == {"long": long, "short": short, "line": one_line}
    whole = text.read_fasta(spark, str(path))
    declared = whole.select(F.lit(0).alias("file_id"), "tid", "name", F.col("len").cast("bigint").alias("len"), F.md5("seq").alias("m5"))
    assert not verify.mismatches(declared, got).head(1)
    off = declared.withColumn("m5", F.when(F.col("tid") == 0, F.md5(F.lit("x"))).otherwise(F.col("m5")))
    assert [(r["name"], r["reason"]) for r in verify.mismatches(off, got).collect()] == [("long", "checksum")]


def test_no_records(spark, tmp_path):
    for name, body in (("empty", ""), ("nameless", "ACGT\nAC\n")):
        (tmp_path / name).write_text(body)
        assert text.read_fasta_pieces(spark, str(tmp_path / name)).collect() == []


def in_pieces(spark, refs, rng):
    rows = []
    for t, seq in enumerate(refs):
        ends = sorted({0, len(seq), *(int(x) for x in rng.integers(0, len(seq) + 1, 5))})
        rows += [(t, f"r{t}", None, len(seq), a, seq[a:b]) for a, b in zip(ends, ends[1:])] or [(t, f"r{t}", None, 0, 0, "")]
    return spark.createDataFrame(rows, "tid int, name string, comment string, len int, from_base bigint, bases string")


@pytest.mark.parametrize("broadcast", [1 << 26, 0])
@pytest.mark.parametrize("cut", [False, True])
def test_reads_find_their_stretch(spark, broadcast, cut, monkeypatch):
    """Short and long reads, in stretches of eight bases, of whole references and of pieces."""
    monkeypatch.setattr(joins, "STRETCH", 8), monkeypatch.setattr(joins, "BROADCAST_BASES", broadcast)
    rng = np.random.default_rng(1)
    refs = ["".join(rng.choice(list("ACGT"), n)) for n in (0, 1, 7, 8, 9, 40, 100)]
    table = in_pieces(spark, refs, rng) if cut else spark.createDataFrame([(t, f"r{t}", None, s, len(s)) for t, s in enumerate(refs)], "tid int, name string, comment string, seq string, len int")
    rows = [(int(t), int(p), "5M", "GATTA", n) for t in range(8) for p in (0, 3, 7, 8, 15, 16, 39, 90, 120) for n in (1, 5, 8, 9, 17, 30, 200)]
    # One place has so many reads that they are spread.
    reads = spark.createDataFrame(rows + [(6, 40, "5M", f"GATTA{i}", 30) for i in range(4000)], "tid int, pos long, cigar string, seq string, n int")
    got = joins.with_stretch(reads, table, F.col("pos") - 2, F.col("n")).collect()
    assert len(got) == len(rows) + 4000
    for r in got:
        ref, start = refs[r["tid"]] if r["tid"] < 7 else "", max(0, r["pos"] - 2)
        assert (r["stretch"], r["stretch_from"]) == (ref[start : start + r["n"]], start) and r["ref_len"] in (len(ref), 0 if start >= len(ref) else len(ref))


def test_profiles_of_pieces_are_those_of_whole_references(spark, monkeypatch):
    monkeypatch.setattr(joins, "STRETCH", 16)
    refs, reads = synthetic.generate(spark, synthetic.Options(references=3, length="60:90", reads="10", unmapped=2))
    whole = [r["seq"] for r in refs.orderBy("tid").collect()]
    cut = in_pieces(spark, whole, np.random.default_rng(3))
    shown = lambda df: sorted(map(str, df.collect()))
    for one, two in ((profile.count_reads(reads, r, with_pairs=True) for r in (refs, cut)),):
        assert all(shown(one[t].drop("name")) == shown(two[t].drop("name")) for t in ("profile", "ref_stats", "lengths", "run"))
        assert one["pairs"].count() == two["pairs"].count() > 0
    assert shown(profile.count_along_alignments(reads, refs)) == shown(profile.count_along_alignments(reads, cut))


def test_streams_take_whole_references(spark, tmp_path):
    spark.createDataFrame([], ALIGNMENTS).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ALIGNMENTS).parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError, match="in pieces"):
        joins.with_stretch(stream, in_pieces(spark, ["ACGT"], np.random.default_rng(0)), F.col("pos"), F.lit(4))
