"""Command line: ``python -m profilewright.cli STEP ...``. Exit status 0, 1 if the run fails, 2 for wrong options or parameters."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from dataclasses import asdict
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .operators import combine, filters, hmm, normalize, profile, score, verify
from .sources import bam, params, runs, synthetic, text

CHOICES = {"verify": ("name", "checksum", "none"), "pairwise": ("correlation", "conditional", "none")}


class UsageError(ValueError):
    """Options or parameters that no run can have."""


def chosen(value: str, choices: tuple[str, ...]) -> frozenset[str]:
    """A comma list of choices; ``none`` stands alone."""
    found = frozenset(value.split(","))
    if not found <= set(choices) or "none" in found and len(found) > 1:
        raise argparse.ArgumentTypeError(f"choose among {', '.join(choices)}")
    return found - {"none"}


#: Steps by name: what adds a step's options to its parser, and what runs it. A further step is one more entry.
STEPS: dict[str, tuple[Callable[[argparse.ArgumentParser], None], Callable[[argparse.Namespace, SparkSession], None]]] = {}


def step(name: str, add_options: Callable[[argparse.ArgumentParser], None]):
    def register(f):
        STEPS[name] = add_options, f
        return f

    return register


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="profilewright", description=__doc__)
    steps = p.add_subparsers(dest="step", required=True)
    for name, (add_options, _) in STEPS.items():
        add_options(steps.add_parser(name))
    for name in ("dump-layout", "dump-params", "dump-options"):
        steps.add_parser(name)
    return p


def options() -> dict[str, list[dict]]:
    """Every step's options: names, default, choices, and whether they must be given or may be repeated."""
    steps = next(x for x in parser()._actions if isinstance(x, argparse._SubParsersAction)).choices
    plain = lambda v: sorted(v) if isinstance(v, frozenset) else v
    return {
        name: [{"names": x.option_strings or [x.dest], "default": plain(x.default), "choices": list(x.choices) if x.choices else None, "required": x.required, "repeated": x.nargs == "+" or isinstance(x, argparse._AppendAction)} for x in step._actions if x.dest != "help"]
        for name, step in steps.items()
    }


def _output(s: argparse.ArgumentParser, **more) -> None:
    s.add_argument("-o", "--output", required=True, **more)
    s.add_argument("--overwrite", action="store_true")


def _alignments(spark: SparkSession, paths: list[str]):
    parts = (bam.read_bam(spark, p) if p.endswith((".bam", ".cram")) else text.read_sam(spark, p, require_sorted=True) for p in paths)
    return reduce(DataFrame.unionByName, (part.withColumn("file_id", F.lit(k)) for k, part in enumerate(parts)))


def _write_pair(spark: SparkSession, made, first: dict, second: dict, a) -> None:
    if not runs.same_shape(first, second):
        raise ValueError("the runs have different references")
    combine.require_agreement(first["profile"], second["profile"])
    runs.write_run({"profile": made, **runs.combined_counts(first, second)}, a.output, a.overwrite)


def _hmm_options(s: argparse.ArgumentParser) -> None:
    _output(s)
    s.add_argument("-f", "--fasta", required=True)
    s.add_argument("alignments", nargs="+")
    s.add_argument("--verify", type=lambda v: chosen(v, CHOICES["verify"]), default=frozenset({"name", "checksum"}))
    s.add_argument("-q", "--min-mapq", type=int, default=20)
    s.add_argument("--min-length", type=int, default=0)
    s.add_argument("--max-length", type=int, default=0)
    s.add_argument("-s", "--strand", type=lambda v: chosen(v, ("forward", "reverse")), default=frozenset({"forward", "reverse"}))
    s.add_argument("--band", type=int, default=2)
    s.add_argument("--min-phred", type=int, default=0)
    s.add_argument("--pairwise", type=lambda v: chosen(v, CHOICES["pairwise"]), default=frozenset())
    s.add_argument("--min-depth", type=float, default=1.0)
    s.add_argument("--params")
    for name, default in (("substitution", 1.0), ("deletion", 1.0), ("insertion", 0.0)):
        s.add_argument(f"--{name}-weight", type=float, default=default)


@step("hmm", _hmm_options)
def run_hmm(a: argparse.Namespace, spark: SparkSession) -> None:
    weights = {f"{n}_weight": getattr(a, f"{n}_weight") for n in ("substitution", "deletion", "insertion")}
    base = hmm.Model(**weights)
    try:
        model = params.parse(Path(a.params).read_text(), base) if a.params else base
        rule = filters.ReadFilter(a.min_mapq, a.min_length, a.max_length, a.strand)
    except (ValueError, OSError) as wrong:
        raise UsageError(str(wrong)) from wrong
    refs, reads = text.read_fasta_pieces(spark, a.fasta), _alignments(spark, a.alignments)
    for k, path in enumerate(a.alignments):
        declared = bam.read_declared(spark, path, k, require_sorted=True) if path.endswith(".bam") else text.read_declared(spark, path, k)
        verify.verify(declared, refs, "name" in a.verify, "checksum" in a.verify)
    filters.refuse_disorder(reads)
    tables = profile.count_reads(reads, refs, rule, a.band, model, a.min_phred, a.min_depth, bool(a.pairwise))
    if "pairs" in tables:
        tables["pairs"] = tables["pairs"].select("tid", "i", "j", *sorted(a.pairwise), "coverage")
    runs.write_run(tables, a.output, a.overwrite)


def _sub_options(s: argparse.ArgumentParser) -> None:
    _output(s)
    s.add_argument("treated"), s.add_argument("untreated"), s.add_argument("--clip", action="store_true")


@step("sub", _sub_options)
def run_sub(a: argparse.Namespace, spark: SparkSession) -> None:
    first, second = (runs.read_run(spark, p, "sub") for p in (a.treated, a.untreated))
    _write_pair(spark, combine.subtract(first["profile"], second["profile"], a.clip), first, second, a)


def _div_options(s: argparse.ArgumentParser) -> None:
    _output(s)
    s.add_argument("rates"), s.add_argument("control")


@step("div", _div_options)
def run_div(a: argparse.Namespace, spark: SparkSession) -> None:
    first, second = (runs.read_run(spark, p, "div") for p in (a.rates, a.control))
    _write_pair(spark, combine.divide(first["profile"], second["profile"]), first, second, a)


def _norm_options(s: argparse.ArgumentParser) -> None:
    _output(s, action="append")
    s.add_argument("rates", nargs="+"), s.add_argument("--norm", choices=("ubr", "outlier"), default="ubr")
    s.add_argument("--min-coverage", type=float, default=normalize.MIN_COVERAGE), s.add_argument("--clip-above", type=float)


@step("norm", _norm_options)
def run_norm(a: argparse.Namespace, spark: SparkSession) -> None:
    if len(a.output) != len(a.rates) or len(a.rates) > 256:
        raise ValueError("give one output for each input, 256 at most")
    inputs = [runs.read_run(spark, p, "norm") for p in a.rates]
    for path in a.output:
        if runs.is_taken(spark, path) and not a.overwrite:
            raise FileExistsError(path)
    made, norm = normalize.normalize([x["profile"] for x in inputs], a.norm, a.min_coverage, a.clip_above)
    for x, p, path in zip(inputs, made, a.output, strict=True):
        noted = x["run"].drop("norm").crossJoin(norm)
        runs.write_run({**{k: v for k, v in x.items() if k != "pairs"}, "profile": p, "run": noted}, path, a.overwrite)


def _score_options(s: argparse.ArgumentParser) -> None:
    s.add_argument("-f", "--fasta", required=True), s.add_argument("-s", "--structures", required=True), s.add_argument("profile")
    s.add_argument("-b", "--bases", default="A,C,G,U"), s.add_argument("--min-coverage", type=float, default=0.0)


@step("score", _score_options)
def run_score(a: argparse.Namespace, spark: SparkSession) -> None:
    refs, marks = text.read_fasta(spark, a.fasta), text.read_structures(spark, a.structures)
    measured = runs.read_run(spark, a.profile)
    score.refuse_longer(refs, measured["run"].first()["n_refs"])
    found = score.score(measured["profile"], refs, marks, a.bases.replace(",", ""), a.min_coverage)
    any_row = False
    for row in score.as_csv_lines(found).toLocalIterator():
        if not any_row:
            print(",".join(row.asDict()))
        any_row = True
        print(",".join(map(str, row)))
    if not any_row:
        raise ValueError(f"nothing was scored; {score.wrong_lengths(refs, marks).count()} structures have another length than their reference")


def _gen_options(s: argparse.ArgumentParser) -> None:
    _output(s)
    for field, value in asdict(synthetic.Options()).items():
        s.add_argument(f"--{field.replace('_', '-')}", type=type(value), default=value)


@step("gen", _gen_options)
def run_gen(a: argparse.Namespace, spark: SparkSession) -> None:
    refs, reads = synthetic.generate(spark, synthetic.Options(**{f: getattr(a, f) for f in asdict(synthetic.Options())}))
    if runs.is_taken(spark, a.output) and not a.overwrite:
        raise FileExistsError(a.output)
    mode = "overwrite" if a.overwrite else "errorifexists"
    text.fasta_lines(refs).write.mode(mode).text(f"{a.output}/references.fasta")
    text.sam_lines(reads, refs).write.mode(mode).text(f"{a.output}/reads.sam")


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.step == "dump-layout":
        print(json.dumps({name: dict(c.split() for c in layout.split(", ")) for name, layout in {**runs.TABLES, "alignments": schema.ALIGNMENTS, "references": schema.REFERENCES}.items()}, indent=1))
        return 0
    if a.step == "dump-options":
        print(json.dumps(options(), indent=1))
        return 0
    if a.step == "dump-params":
        print(params.dump(hmm.Model()), end="")
        return 0
    spark = SparkSession.builder.appName("profilewright").getOrCreate()
    try:
        STEPS[a.step][1](a, spark)
    except Exception as failure:
        print(f"profilewright: {failure}", file=sys.stderr)
        return 2 if isinstance(failure, UsageError) else 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
