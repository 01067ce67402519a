"""The command line from end to end, on generated files."""

import math

from profilewright import cli
from profilewright.sources import runs, text
from tests.test_bam import bgzf, head, record


def test_steps_follow_each_other(spark, tmp_path, capsys):
    at = lambda name: str(tmp_path / name)
    assert cli.main(["gen", "-o", at("data"), "--references", "5", "--length", "40:60", "--reads", "8", "--span", "20:40", "--unmapped", "3"]) == 0
    data = at("data") + "/reads.sam", at("data") + "/references.fasta"
    assert cli.main(["gen", "-o", at("data")]) == 1  # taken
    for name in ("a", "b"):
        assert cli.main(["hmm", "-f", data[1], "-o", at(name), "--pairwise", "correlation", data[0]]) == 0
    run = runs.read_run(spark, at("a"))
    assert set(run) == set(runs.TABLES) and "conditional" not in run["pairs"].columns and run["run"].first()["unmapped"] == 3
    assert run["profile"].count() == text.read_fasta(spark, data[1]).selectExpr("sum(len)").first()[0]
    assert cli.main(["sub", "-o", at("less"), at("a"), at("b")]) == 0
    less = runs.read_run(spark, at("less"))
    assert all(r["reactivity"] == 0 or math.isnan(r["reactivity"]) for r in less["profile"].collect()) and less["run"].first()["unmapped"] == 6
    assert cli.main(["div", "-o", at("ratio"), at("a"), at("b")]) == 0
    assert {r["reactivity"] for r in runs.read_run(spark, at("ratio"))["profile"].collect() if not math.isnan(r["reactivity"])} <= {1.0}
    assert cli.main(["norm", "-o", at("scaled"), "--min-coverage", "1", at("a")]) == 0
    assert runs.read_run(spark, at("scaled"))["run"].first()["norm"] > 0
    refs = {r["name"]: r["len"] for r in text.read_fasta(spark, data[1]).collect()}
    (tmp_path / "pairs").write_text("".join(f">{n}\n{'.(' * (k // 2)}{'.' * (k % 2)}\n" for n, k in refs.items()))
    capsys.readouterr()
    assert cli.main(["score", "-f", data[1], "-s", at("pairs"), at("a")]) == 0
    lines = capsys.readouterr().out.splitlines()
    assert lines[0].startswith("name,paired,unpaired") and 1 < len(lines) <= 6


def test_wrong_inputs_are_refused_and_leave_what_was_there(spark, tmp_path):
    seq = "ACGTACGTAC"
    (tmp_path / "refs").write_text(f">a\n{seq}\n>b\n{seq}\n")
    (tmp_path / "one").write_text(f">a\n{seq}\n")
    head = "@HD\tVN:1.6\tSO:coordinate\n@SQ\tSN:a\tLN:10\n@SQ\tSN:b\tLN:10\n"
    read = lambda name, pos=1: f"r\t0\t{name}\t{pos}\t60\t10M\t*\t0\t0\t{seq}\t*\n"
    for name, content in (("good", head + read("a") + read("b")), ("backwards", head + read("b") + read("a")), ("unsorted", head.replace("coordinate", "unknown") + read("a")), ("other", head.replace("SN:b", "SN:c") + read("a"))):
        (tmp_path / name).write_text(content)
    hmm = lambda name, *more: cli.main(["hmm", "-f", str(tmp_path / "refs"), "-o", str(tmp_path / "run"), "--overwrite", *more, str(tmp_path / name)])
    assert hmm("good") == 0
    before = runs.read_run(spark, str(tmp_path / "run"))["profile"].count()
    assert [hmm("backwards"), hmm("unsorted"), hmm("other")] == [1, 1, 1] and hmm("other", "--verify", "none") == 0
    assert runs.read_run(spark, str(tmp_path / "run"))["profile"].count() == before == 20
    (tmp_path / "marks").write_text(">a\n.(.(.(.(.(\n")
    more = tmp_path / "more"
    more.write_text(f">a\n{seq}\n>b\n{seq}\n>c\n{seq}\n")
    assert cli.main(["score", "-f", str(more), "-s", str(tmp_path / "marks"), str(tmp_path / "run")]) == 1  # longer than the profile
    assert cli.main(["score", "-f", str(tmp_path / "one"), "-s", str(tmp_path / "marks"), str(tmp_path / "run")]) == 0
    (tmp_path / "wrong").write_text("substitution 7\n")
    assert hmm("good", "--params", str(tmp_path / "wrong")) == 2 and hmm("good", "--min-length", "9", "--max-length", "3") == 2


def test_sam_and_bam_in_one_run(spark, tmp_path):
    seq = "ACGTACGTAC"
    names = [f"ref{i:02d}"[:5] for i in range(2)]
    sizes = [1000, 1001]
    (tmp_path / "refs").write_text("".join(f">{n}\n{'ACGT' * (k // 4)}{'ACGT'[: k % 4]}\n" for n, k in zip(names, sizes, strict=True)))
    (tmp_path / "a.sam").write_text("@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:{n}\tLN:{k}\n" for n, k in zip(names, sizes, strict=True)) + f"r\t0\t{names[0]}\t1\t60\t10M\t*\t0\t0\t{seq}\t*\n")
    (tmp_path / "b.bam").write_bytes(bgzf(head(2) + record(0, 0, seq, [(10, "M")]) + record(1, 4, seq, [(10, "M")]), 100))
    assert cli.main(["hmm", "-f", str(tmp_path / "refs"), "-o", str(tmp_path / "run"), str(tmp_path / "a.sam"), str(tmp_path / "b.bam")]) == 0
    stats = {r["tid"]: r["counted"] for r in runs.read_run(spark, str(tmp_path / "run"))["ref_stats"].collect()}
    assert stats == {0: 2, 1: 1}
