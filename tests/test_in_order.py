"""References given out in order while their inputs still grow."""

import os

import numpy as np
import pytest

from profilewright.operators import filters
from profilewright.operators.exact import exact_sum
from profilewright.operators.pileup import pileup
from profilewright.operators.profile import tangled_contributions
from profilewright.schema import ALIGNMENTS, REFERENCES
from profilewright.streaming import in_order

REF = "ACGTTGCAACGGTACCATGCATTACGGATC"
CIGARS = {"10M": 10, "4M1D6M": 10, "3M2I5M": 10, "4M1I1D1I4M": 10}


def reads_of(tid, rng, n=6):
    rows = []
    for k in range(n):
        cigar = list(CIGARS)[k % len(CIGARS)]
        rows.append((0, k, tid, int(rng.integers(0, 15)), 0, 60, cigar, "".join(rng.choice(list("ACGT"), 10)), "I" * 10, 10))
    rows[-1] = (*rows[-1][:5], 3, *rows[-1][6:])  # not counted, for its quality
    return rows


UNMAPPED = (0, 99, -1, -1, 4, 0, None, "ACGT", "IIII", 4)


def grown(spark, folder, files):
    """A stream of a file a batch."""
    for k, rows in enumerate(files):
        part = str(folder / f"part-{k}")
        spark.createDataFrame(rows, ALIGNMENTS).coalesce(1).write.parquet(part)
        for name in os.listdir(part):
            if name.endswith(".parquet"):
                os.rename(f"{part}/{name}", folder / f"{k}.parquet")
        os.utime(folder / f"{k}.parquet", (1e9 + k, 1e9 + k))
    return spark.readStream.schema(ALIGNMENTS).option("maxFilesPerTrigger", 1).parquet(str(folder / "*.parquet"))


def started(found, name, path):
    return found.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(path)).trigger(availableNow=True).start()


@pytest.fixture
def refs(spark):
    return spark.createDataFrame([(t, f"r{t}", None, REF, len(REF)) for t in range(5)], REFERENCES)


def test_references_come_when_all_inputs_have_passed_them(spark, tmp_path, refs):
    rng = np.random.default_rng(2)
    r = lambda *tids: [x for t in tids for x in reads_of(t, rng)]
    first = [r(0), r(1, 2), r(2), r(4), [UNMAPPED]]
    second = [r(0, 1), r(1), r(3), r(3, 4), [UNMAPPED]]
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir(), b.mkdir()
    q = started(in_order.finished_sums([grown(spark, a, first), grown(spark, b, second)], refs, min_phred=5), "in_order", tmp_path / "state")
    assert in_order.refuse_returns(spark, q, 120)
    good = filters.mapped(spark.createDataFrame([x for f in first + second for x in f], ALIGNMENTS)).filter(filters.accepted(filters.ReadFilter()))
    both = pileup(good, refs, min_phred=5).unionByName(tangled_contributions(good, refs, min_phred=5))
    key = lambda df: {(x["tid"], x["pos"]): [x[c] for c in in_order.SUMS] for x in df.collect()}
    want, got = key(both.groupBy("tid", "pos").agg(*(exact_sum(c).alias(c) for c in in_order.SUMS))), key(spark.table("in_order"))
    assert got.keys() == want.keys() and {t for t, _ in got} == {0, 1, 2, 3, 4} and all(np.allclose(got[k], want[k], atol=1e-12) for k in got)
    held = [s.numRowsTotal for p in q.recentProgress for s in p.stateOperators]
    removed = [s.numRowsRemoved for p in q.recentProgress for s in p.stateOperators]
    assert held[-1] == 0 and max(held) < sum(removed) and sum(x > 0 for x in removed) > 2


def test_a_reference_that_comes_back_is_refused(spark, tmp_path, refs):
    rng = np.random.default_rng(3)
    folder = tmp_path / "a"
    folder.mkdir()
    q = started(in_order.finished_sums([grown(spark, folder, [reads_of(t, rng) for t in (0, 2, 3, 1)])], refs), "come_back", tmp_path / "state")
    with pytest.raises(ValueError, match="not sorted"):
        in_order.refuse_returns(spark, q, 120)


def test_what_no_later_read_follows_is_held_back(spark, tmp_path, refs):
    rng = np.random.default_rng(4)
    folder = tmp_path / "a"
    folder.mkdir()
    q = started(in_order.finished_sums([grown(spark, folder, [reads_of(0, rng), reads_of(3, rng)])], refs), "held_back", tmp_path / "state")
    assert in_order.refuse_returns(spark, q, 120) and {x["tid"] for x in spark.table("held_back").collect()} == {0}
