"""Profiles: combination, scale, scores, pairs, and runs on disk."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from profilewright.joins import with_sums_before
from profilewright import joins
from profilewright.operators import combine, normalize, pairs, profile, score
from profilewright.plans import bindings
from profilewright.schema import LENGTHS, PROFILE, REF_STATS, REFERENCES, RUN, STRUCTURES, fields_for
from profilewright.sources import runs

NAN = float("nan")


def profile_of(spark, rates, errors=None, coverage=None):
    n = len(rates)
    rows = [(0, i, i % 4, float((coverage or [1000.0] * n)[i]), float(rates[i]), float((errors or [0.0] * n)[i])) for i in range(n)]
    return spark.createDataFrame(rows, PROFILE)


def column(df, name):
    return [r[name] for r in df.orderBy("tid", "pos").collect()]


def same(a, b, tol=1e-6):
    return len(a) == len(b) and all((math.isnan(x) and math.isnan(y)) or abs(x - y) <= tol * max(1, abs(y)) for x, y in zip(a, b, strict=True))


def test_subtraction(spark):
    t, u = profile_of(spark, [0.25, 0.5, NAN, 0.1], [0.3, NAN, 0.1, 0.0]), profile_of(spark, [0.75, 0.25, 0.1, NAN], [0.4, 0.1, 0.1, 0.0])
    made = combine.subtract(t, u)
    assert same(column(made, "reactivity"), [-0.5, 0.25, NAN, NAN]) and same(column(made, "error"), [0.5, NAN, math.sqrt(0.02), 0.0])
    assert same(column(combine.subtract(t, u, clip=True), "reactivity"), [0.0, 0.25, NAN, NAN])
    assert column(made, "coverage") == [2000.0] * 4
    assert same(column(combine.subtract(t, t), "reactivity"), [0, 0, NAN, 0])
    assert "error" not in combine.subtract(t.drop("error"), u).columns


def test_division(spark):
    r, c = profile_of(spark, [0.5, 0.5, 0.5, 0.5, NAN], [0.1] * 5), profile_of(spark, [0.25, 0.0, -0.25, NAN, 0.5], [0.2] * 5)
    made = combine.divide(r, c)
    assert same(column(made, "reactivity"), [2.0, NAN, NAN, NAN, NAN])
    assert same(column(made, "error"), [math.sqrt(0.01 + 0.4**2) / 0.25, NAN, NAN, NAN, NAN])
    with pytest.raises(ValueError):
        combine.divide(r.drop("error"), c)
    clipped = combine.subtract(profile_of(spark, [0.25], [0.3]), profile_of(spark, [0.75], [0.4]), clip=True)
    assert same(column(combine.divide(clipped, profile_of(spark, [0.5], [9.0])), "error"), [1.0])


def test_disagreement_is_refused(spark):
    a = profile_of(spark, [0.1, 0.2, 0.3])
    combine.require_agreement(a, a)
    for b in (a.withColumn("base", F.lit(3).cast("tinyint")), a.filter("pos < 2")):
        with pytest.raises(ValueError):
            combine.require_agreement(a, b)
    total = combine.add_counts(a.select("tid", F.lit(3).cast("long").alias("n")).limit(1), a.select("tid", F.lit(2**40 + 1).alias("n")).limit(1), ["tid"], ["n"])
    assert total.first()["n"] == 2**40 + 4


@pytest.mark.parametrize("n", [0, 1, 2, 7, 50, 333])
@pytest.mark.parametrize("scheme", ["ubr", "outlier"])
def test_scales_follow_their_definition(spark, scheme, n):
    rng = np.random.default_rng(n)
    rates = np.round(rng.random(n), 2).tolist() + [NAN, float("inf")]
    df = profile_of(spark, rates, coverage=[1000.0] * (n + 1) + [NAN])
    got = normalize.scale_of([df], scheme).first()[0]
    pool = np.sort(np.float32(rates[:n]).astype(float))[::-1]
    if scheme == "ubr":
        want = np.percentile(pool, 90) if n else 1.0
    else:
        half_up = lambda x: int(math.floor(x + 0.5))
        high, low = max(1, half_up(0.02 * n)) - 1, max(1, half_up(0.1 * n)) - 1
        want = pool[high : low + 1].mean() if n >= 2 else 1.0
    assert got == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("accuracy", [10_000, 2])
def test_order_statistics_are_exact_however_rates_lie(spark, monkeypatch, accuracy):
    """Wide brackets and few rows at once, so that ranks are looked for in stretches of stretches, and a coarse sketch that misses them: outliers, ties, and rates next to each other."""
    monkeypatch.setattr(normalize, "REACH", 0.2)
    monkeypatch.setattr(normalize, "ACCURACY", accuracy)
    rng = np.random.default_rng(2)
    for rates in (rng.random(300), np.concatenate([rng.random(200) * 1e-9, [1e9, -1e300]]), np.repeat([0.5, 0.25], 60), np.nextafter(1, 2) ** np.arange(50), [3.0]):
        df, want = spark.createDataFrame([(float(x),) for x in rates], "rate double"), np.sort(rates)
        ranks = [0, len(want) // 3, len(want) - 1]
        assert normalize.values_at(df, [0, 1 / 3, 1], lambda _, r=ranks: r, most=45) == (len(want), [want[k] for k in ranks])


def test_running_sums_span_tasks(spark):
    """One group over many ranges, and many groups in one."""
    rng = np.random.default_rng(3)
    rows = [(0, float(v), int(rng.integers(0, 5))) for v in rng.permutation(3000)] + [(g, float(v), g) for g in range(1, 40) for v in range(3)] + [(None, 1.0, 7)]
    got = with_sums_before(spark.createDataFrame(rows, "g int, v double, n long"), "g", "v", ["n"], "t").collect()
    assert len(got) == len(rows) - 1  # a row without a group is in none
    for g in (0, 7):
        mine = sorted((r[1], r[2]) for r in rows if r[0] == g)
        before = np.cumsum([0] + [n for _, n in mine])
        assert sorted((r["v"], r["before_n"], r["all_n"]) for r in got if r["g"] == g) == [(v, b, before[-1]) for (v, _), b in zip(mine, before, strict=False)]


def test_scales_apply(spark):
    (made,), norm = normalize.normalize([profile_of(spark, [0.25, 0.25, NAN])])
    assert same(column(made, "reactivity"), [1, 1, NAN]) and norm.first()[0] == 0.25
    (made,), norm = normalize.normalize([profile_of(spark, [0.0, 0.0])])
    assert column(made, "reactivity") == [0, 0] and math.isnan(norm.first()[0])
    (made,), norm = normalize.normalize([profile_of(spark, [0.5, 2.0, NAN], coverage=[500.0] * 3)], clip_above=1.0)
    assert same(column(made, "reactivity"), [0.5, 1.0, NAN]) and norm.first()[0] == 1.0
    with pytest.raises(ValueError):
        normalize.scale_of([made], "other")


def scored(spark, values, bases="ACGU", coverage=None, floor=0.0, pairing=".(.(.(", seq="ACGUAC"):
    refs = spark.createDataFrame([(0, "one", None, seq, len(seq)), (1, "two", None, "A", 1)], REFERENCES)
    marks = spark.createDataFrame([("one", pairing), ("three", "...")], STRUCTURES)
    return score.score(profile_of(spark, values, coverage=coverage), refs, marks, bases, floor).collect()


def test_scores(spark):
    one = scored(spark, [9.0, 1, 8, 2, 7, 3])[0]
    assert (one["auroc"], one["auprc"], one["paired"], one["unpaired"]) == (1, 1, 3, 3)
    assert scored(spark, [1.0, 9, 2, 8, 3, 7])[0]["auroc"] == 0
    assert scored(spark, [4.0] * 6)[0]["auroc"] == 0.5
    means = scored(spark, [1.0, 3, 1, 3, 1, 3])[0]
    assert (means["mean_unpaired"], means["mean_paired"]) == (1, 3)
    assert sum(scored(spark, [9.0, 1, 8, 2, 7, 3], bases="AC")[0][k] for k in ("paired", "unpaired")) == 4
    assert sum(scored(spark, [9.0, 1, 8, 2, 7, 3], coverage=[100.0] * 3 + [1.0] * 3, floor=50)[0][k] for k in ("paired", "unpaired")) == 3
    assert scored(spark, [1.0] * 6, pairing="......") == [] and scored(spark, [1.0] * 6, pairing="...") == []
    assert sum(scored(spark, [9.0, 1, 8, 2, 7, 3], pairing="-(.(.(")[0][k] for k in ("paired", "unpaired")) == 5


def test_more_references_than_rows_are_refused(spark):
    refs = spark.createDataFrame([(0, "a", None, "A", 1), (1, "b", None, "A", 1)], REFERENCES)
    score.refuse_longer(refs, 2), score.refuse_longer(refs, 3)
    with pytest.raises(ValueError):
        score.refuse_longer(refs, 1)


def test_area_is_the_share_of_ordered_pairs(spark):
    rng = np.random.default_rng(0)
    values, is_open = rng.integers(0, 9, 200).astype(float), rng.random(200) < 0.4
    rows = [(0, float(v), bool(o)) for v, o in zip(values, is_open, strict=True)]
    got = score.metrics(spark.createDataFrame(rows, "tid int, value double, open boolean")).first()
    a, b = values[is_open][:, None], values[~is_open][None, :]
    assert got["auroc"] == pytest.approx(((a > b) + 0.5 * (a == b)).mean())
    order = np.unique(values)[::-1]
    found = [(is_open & (values >= v)).sum() for v in order]
    seen = [(values >= v).sum() for v in order]
    assert got["auprc"] == pytest.approx(sum((f - p) / is_open.sum() * f / s for f, p, s in zip(found, [0, *found], seen, strict=False)))


def test_pairs(spark):
    rng = np.random.default_rng(1)
    m = (rng.random((40, 4)) < 0.5).astype(float)
    rows = [(0, r, p, 1.0, 1.0, float(m[r, p])) for r in range(40) for p in range(4)]
    sums = pairs.pair_sums(spark.createDataFrame(rows, "tid int, read int, pos int, coverage double, spanned double, mutations double"))
    got = {(r["i"], r["j"]): r for r in pairs.statistics(sums).collect()}
    assert len(got) == 16
    want = np.corrcoef(m.T)
    for (i, j), r in got.items():
        assert r["correlation"] == pytest.approx(want[i, j], abs=1e-6) and r["coverage"] == 40
        assert r["conditional"] == pytest.approx((m[:, i] * m[:, j]).sum() / m[:, j].sum(), abs=1e-6)
    assert all(math.isnan(r["correlation"]) for r in pairs.statistics(sums, min_depth=41).collect())


def test_positions_without_reads_have_a_row(spark):
    refs = spark.createDataFrame([(0, "a", None, "ACGUNa", 6), (1, "b", None, "", 0)], REFERENCES)
    sums = spark.createDataFrame([(0, 2, 3.0, 4.0, 1.0), (0, 3, 0.0, 0.5, 0.5)], "tid int, pos int, coverage double, spanned double, mutations double")
    made = profile.profile(refs, sums)
    assert column(made, "base") == [0, 1, 2, 3, -1, 0]
    assert same(column(made, "reactivity"), [NAN, NAN, 0.25, NAN, NAN, NAN]) and same(column(made, "error"), [NAN, NAN, math.sqrt(0.25 * 0.75 / 4), NAN, NAN, NAN])
    dense = profile.to_dense(made, refs, "coverage", 0.0).collect()
    assert dense[0]["values"] == [0, 0, 3, 0, 0, 0]


def test_runs_are_kept_whole(spark, tmp_path):
    run = spark.createDataFrame([("x", "1", 1, 3, 7, NAN)], RUN)
    tables = {"profile": profile_of(spark, [0.1, 0.2, 0.3]), "run": run, "ref_stats": spark.createDataFrame([(0, "a", 3, 5, 1)], REF_STATS), "lengths": spark.createDataFrame([(0, 3, 5)], LENGTHS)}
    path = str(tmp_path / "run")
    runs.write_run(tables, path)
    with pytest.raises(FileExistsError):
        runs.write_run(tables, path)
    broken = {**tables, "profile": tables["profile"].withColumn("coverage", F.when(F.col("pos") == 1, F.raise_error(F.lit("broken")).cast("float")).otherwise(1))}
    with pytest.raises(Exception):
        runs.write_run(broken, path, overwrite=True)
    runs.write_run(tables, path, overwrite=True)
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith("_writing")] == ["run"]
    back = runs.read_run(spark, path, "sub")
    assert column(back["profile"], "pos") == [0, 1, 2] and runs.same_shape(back, tables)
    both = runs.combined_counts(back, back)
    assert both["run"].first()["unmapped"] == 14 and both["lengths"].first()["n"] == 10 and both["ref_stats"].first()["counted"] == 10
    with pytest.raises(ValueError):
        runs.write_run({"profile": tables["profile"]}, path, overwrite=True)
    assert fields_for("sub", back["profile"].drop("error")) == ["coverage", "reactivity", "base"]


def test_options_are_described(capsys):
    import json

    from profilewright import cli

    assert cli.main(["dump-options"]) == 0
    found = json.loads(capsys.readouterr().out)
    band = next(x for x in found["hmm"] if "--band" in x["names"])
    assert band["default"] == 2 and not band["required"] and {"sub", "div", "norm", "score", "gen"} <= set(found)
    assert next(x for x in found["norm"] if "--output" in x["names"])["repeated"]


def test_scratch_tables_can_be_cleared(spark, tmp_path):
    import os

    from profilewright import scratch

    made = scratch.materialize(spark.range(5), "x")
    assert made.count() == 5
    own = scratch.own_dir(spark).removeprefix("file://")
    assert os.path.isdir(own)
    scratch.clear(spark)
    assert not os.path.exists(own) and scratch.materialize(spark.range(2), "x").count() == 2


def test_scores_are_printed_as_c_prints_them(spark):
    rows = [(0, "a", 8, 8, 0.578125, 0.000015, 0.5, 123456.5), (1, "b", 1, 1, 0.328125, 1.0, 1e-7, 2.0)]
    kept = spark.createDataFrame(rows, "tid int, name string, paired long, unpaired long, auroc double, auprc double, mean_paired double, mean_unpaired double")
    got = [tuple(r) for r in score.as_csv_lines(kept).collect()]
    assert got == [("a", 8, 8, *("%.5f,%.5f,%.6g,%.6g" % rows[0][4:]).split(",")), ("b", 1, 1, "0.32812", "1.00000", "1e-07", "2")]
    assert got[0][3] == "0.57812"


def test_pairs_are_dealt_once_to_tasks_by_the_number_of_lines(spark, tmp_path, monkeypatch):
    lines = [(k // 3, k % 3 + 1, "R" if k % 4 == 0 else "N") for k in range(900)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(k, f"{k % 5 + 1}-X") for k in range(300)], "o_orderkey long, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    want = bindings.pair_events(spark, str(tmp_path))
    monkeypatch.setattr(joins, "ROWS_OF_A_TASK", 10)
    events = bindings.pair_events(spark, str(tmp_path))
    assert sorted(want.collect()) == sorted(events.collect())
    plan = pairs.pair_sums(events)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("l_orderkey#") and plan.count("Exchange hashpartitioning") == 3 and ", 90)" in plan  # lines, orders, and the sums


def test_the_curve_is_walked_from_the_highest_value_down(spark, monkeypatch):
    """The steps add up to 237/40, over 8: a printed score that lies between two digits, which only this order rounds up."""
    is_open = [1, 1, 0, 0, 1, 1, 0, 1, 1, 1, 0, 1, 0, 0]
    rows = [(tid, float(100 - k), bool(o)) for tid in range(40) for k, o in enumerate(is_open)]
    points = spark.createDataFrame(rows, "tid int, value double, open boolean").repartition(7)
    found = found_steps = 0
    for seen, o in enumerate(is_open, 1):
        found += o
        found_steps += o * found / seen
    assert "%.5f" % (found_steps / 8) == "0.74063"
    assert {r["auprc"] for r in score.metrics(points).collect()} == {found_steps / 8}
    monkeypatch.setattr(score, "WALKED", 7)
    long = {r["auprc"] for r in score.metrics(points).collect()}
    assert len(long) == 1 and long.pop() == pytest.approx(237 / 320, rel=1e-14)
