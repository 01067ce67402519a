"""A window of a run's pairs is read without the rest of them."""

import math

import pytest
from pyspark.sql import functions as F

from profilewright.schema import RUN
from profilewright.sources import runs


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    n = 1300
    pairs = spark.range(2 * n * n).select((F.col("id") / (n * n)).cast("int").alias("tid"), (F.col("id") / n % n).cast("int").alias("i"), (F.col("id") % n).cast("int").alias("j"))
    value = ((F.col("i") * 7 + F.col("j") * 3 + F.col("tid")) % 101 / 100).cast("float")
    path = str(tmp_path_factory.mktemp("pairs") / "run")
    profile = spark.createDataFrame([(0, 0, 0, 1.0, 0.5, 0.1)], "tid int, pos int, base tinyint, coverage float, reactivity float, error float")
    table = spark.createDataFrame([("p", "1", 2, n, 0, math.nan)], RUN)
    runs.write_run({"profile": profile, "run": table, "pairs": pairs.repartition(8, "j").select("tid", "i", "j", value.alias("correlation"), value.alias("coverage"))}, path)
    return path, n


@pytest.mark.parametrize("tid, first, second", [(0, (0, 1), (0, 1)), (1, (500, 1000), (0, 500)), (1, (255, 257), (1290, 1400)), (0, (5, 5), (0, 9)), (2, (0, 9), (0, 9))])
def test_a_window_is_read_alone(spark, run, tid, first, second):
    path, n = run
    window = runs.read_pairs(spark, path, tid, first, second)
    rows = window.collect()
    want = {(i, j) for i in range(first[0], min(first[1], n)) for j in range(second[0], min(second[1], n))} if tid < 2 else set()
    assert {(r["i"], r["j"]) for r in rows} == want and len(rows) == len(want)
    assert all(abs(r["correlation"] - (r["i"] * 7 + r["j"] * 3 + tid) % 101 / 100) < 1e-6 for r in rows)
    scanned = window._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().get("numOutputRows").get().value()
    squares = math.prod((b - 1) // runs.SQUARE - a // runs.SQUARE + 1 if b > a else 0 for a, b in (first, second))
    # A page has 20,000 rows, and a window's squares may begin and end inside one.
    assert len(want) <= scanned <= squares * (runs.SQUARE**2 + 2 * 20000) < 2 * n * n / 3


def test_a_run_with_pairs_comes_back_whole(spark, run):
    back = runs.read_run(spark, run[0])["pairs"]
    assert back.count() == back.select("tid", "i", "j").distinct().count() == 2 * run[1] ** 2 and back.columns == ["tid", "i", "j", "correlation", "coverage"]
