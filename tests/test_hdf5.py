"""HDF5 profiles: a file laid out by hand, files there and back in small splits, and files that are refused."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from profilewright import schema
from profilewright.operators import combine
from profilewright.sources import hdf5, runs


def plain(df):
    return sorted((tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in r) for r in df.collect()), key=repr)


def by_hand(values):
    """One unfiltered field, coverage, stored in one piece; its header goes on in a second block, and its dataspace is of version 2."""
    data = np.asarray(values, "<f4")
    message = lambda kind, body: struct.pack("<HHB3x", kind, len(body + bytes(-len(body) % 8)), 0) + body + bytes(-len(body) % 8)
    places, at = {}, 96
    for name, size in (("root", 40), ("tree", 544), ("heap", 32), ("names", 24), ("leaf", 328), ("head", 40), ("rest", 96), ("data", data.nbytes)):
        places[name], at = at, at + size
    space = message(1, struct.pack("<BBBB2Q", 2, 2, 0, 1, *data.shape))
    kind = message(3, struct.pack("<4BIHH4BI", 0x11, 0x20, 31, 0, 4, 0, 32, 23, 8, 0, 23, 127))
    layout = message(8, struct.pack("<BBQQ", 3, 1, places["data"], data.nbytes))
    parts = {
        "root": struct.pack("<BBHII4x", 1, 0, 1, 1, 24) + message(0x11, struct.pack("<QQ", places["tree"], places["heap"])),
        "tree": struct.pack("<4sBBHQQQQQ", b"TREE", 0, 0, 1, hdf5._NONE, hdf5._NONE, 0, places["leaf"], 8),
        "heap": struct.pack("<4sB3xQQQ", b"HEAP", 0, 24, 1, places["names"]),
        "names": b"\0" * 8 + b"coverage\0",
        "leaf": struct.pack("<4sBBHQQI", b"SNOD", 1, 0, 1, 8, places["head"], 0),
        "head": struct.pack("<BBHII4x", 1, 0, 4, 1, 24) + message(0x10, struct.pack("<QQ", places["rest"], len(space + kind + layout))),
        "rest": space + kind + layout,
        "data": data.tobytes(),
    }
    out = bytearray(at)
    out[:96] = b"\x89HDF\r\n\x1a\n" + struct.pack("<8BHHI", 0, 0, 0, 0, 0, 8, 8, 0, 4, 16, 0) + struct.pack("<QQQQ", 0, hdf5._NONE, at, hdf5._NONE) + struct.pack("<QQI4x16x", 0, places["root"], 0)
    for name, part in parts.items():
        out[places[name] : places[name] + len(part)] = part
    return bytes(out)


@pytest.mark.parametrize("size", [hdf5.CHUNK_BYTES, 40])
def test_a_file_laid_out_by_hand(spark, tmp_path, monkeypatch, size):
    """Whole, and in pieces of two rows and one."""
    monkeypatch.setattr(hdf5, "CHUNK_BYTES", size)
    values = np.arange(12).reshape(3, 4) + 0.5
    (tmp_path / "a.h5").write_bytes(by_hand(values))
    run = hdf5.read_hdf5(spark, str(tmp_path / "a.h5"))
    assert set(run) == {"profile", "run"} and run["profile"].columns == ["tid", "pos", "coverage"]
    assert plain(run["profile"]) == sorted(((t, p, float(values[t, p])) for t in range(3) for p in range(4)), key=repr)
    assert tuple(run["run"].first())[2:5] == (3, 4, 0)


def tables_of(spark, lens, seed=1, pairs=True):
    rng, cap = np.random.default_rng(seed), max(lens)
    profile, lengths, stats, squares = [], [], [], []
    for t, n in enumerate(lens):
        for p in range(n):
            known = rng.random() < 0.7
            profile.append((t, p, int(rng.integers(-1, 4)), float(np.float32(rng.random() * 1000)), float(np.float32(rng.random())) if known else math.nan, float(np.float32(rng.random())) if known else math.nan))
        stats.append((t, f"ref{t}", n, int(rng.integers(0, 1 << 41)), int(rng.integers(0, 9))))
        lengths += [(t, int(k), int(rng.integers(1, 1 << 41))) for k in rng.choice(2 * cap, min(3, 2 * cap), replace=False) + 1]
        squares += [(t, int(i), int(j), float(np.float32(rng.random())), math.nan if j % 3 else 0.25, float(np.float32(rng.random() + 1))) for i in range(0, n, 7) for j in range(0, n, 5)]
    out = {"profile": spark.createDataFrame(profile, schema.PROFILE), "lengths": spark.createDataFrame(lengths, schema.LENGTHS), "ref_stats": spark.createDataFrame(stats, schema.REF_STATS), "run": spark.createDataFrame([("p", "1.2", len(lens), cap, 1 << 40, 0.75)], schema.RUN)}
    return out | ({"pairs": spark.createDataFrame(squares, schema.PAIRS)} if pairs else {})


@pytest.mark.parametrize(("lens", "small"), [([40, 3, 17, 40], False), ([300] * 5 + [11], True), ([1], False), ([60] * 150, True)])
def test_runs_there_and_back(spark, tmp_path, monkeypatch, lens, small):
    """Small chunks and splits: indexes of two levels, chunks over several splits, many in one."""
    if small:
        monkeypatch.setattr(hdf5, "CHUNK_BYTES", 1024 if len(lens) < 100 else 240)
        monkeypatch.setattr(hdf5, "SQUARE", 64)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000"), spark.conf.set("spark.sql.files.openCostInBytes", "0")
    tables = tables_of(spark, lens, pairs=len(lens) < 100)
    path = str(tmp_path / "run.h5")
    try:
        hdf5.write_hdf5(tables, path)
        refs = tables["ref_stats"].select("tid", "name", "len")
        back = hdf5.read_hdf5(spark, path, refs)
        for name in tables:
            assert back[name].columns == tables[name].columns, name
            assert plain(back[name]) == plain(tables[name]), name
        with pytest.raises(FileExistsError):
            hdf5.write_hdf5(tables, path)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes"), spark.conf.unset("spark.sql.files.openCostInBytes")


def test_equal_runs_are_equal_files_and_missing_fields_stay_missing(spark, tmp_path):
    tables = tables_of(spark, [30, 20])
    tables["profile"] = tables["profile"].drop("error")
    for name in ("a", "b"):
        hdf5.write_hdf5({k: v.repartition(3) for k, v in tables.items() if k in ("profile", "run")}, str(tmp_path / name))
    assert (tmp_path / "a").read_bytes() == (tmp_path / "b").read_bytes()
    back = hdf5.read_hdf5(spark, str(tmp_path / "a"))
    assert back["profile"].columns == ["tid", "pos", "base", "coverage", "reactivity"] and set(back) == {"profile", "run"}
    beyond = back["profile"].filter("tid = 1 and pos >= 20")  # without references, up to the longest, with fills
    assert beyond.count() == 10 and beyond.filter(F.isnan("reactivity") & (F.col("coverage") == 0) & (F.col("base") == -1)).count() == 10


def test_what_is_not_read_here_is_refused_by_name(spark, tmp_path):
    write = lambda name, content: (tmp_path / name).write_bytes(content) and str(tmp_path / name)
    good = by_hand(np.ones((2, 2)))
    with pytest.raises(ValueError, match="not an HDF5"):
        hdf5.read_layout(spark, write("x", b"GIF89a" + bytes(200)))
    with pytest.raises(ValueError, match="superblock version 2"):
        hdf5.read_layout(spark, write("v2", good[:8] + b"\2" + good[9:]))
    with pytest.raises(ValueError, match="breaks off"):
        hdf5.read_layout(spark, write("short", good[:700]))
    with pytest.raises(ValueError, match="no field coverage"):
        hdf5.read_layout(spark, write("other", good.replace(b"coverage", b"coverbge")))
    hdf5.write_hdf5(tables_of(spark, [9], pairs=False), str(tmp_path / "f"))
    filters = (tmp_path / "f").read_bytes()
    szip = filters.replace(struct.pack("<HHHH8s", 1, 8, 1, 1, b"deflate"), struct.pack("<HHHH8s", 4, 8, 1, 1, b"deflate"))
    with pytest.raises(ValueError, match="filter szip"):
        hdf5.read_layout(spark, write("szip", szip))


def test_filters_that_a_chunk_left_out():
    own = hdf5.Dataset((4,), "<u8", chunk=(4,), filters=(2, 1))
    values = np.arange(4, dtype="<u8") * 1000
    assert (hdf5.decode(hdf5.encode(values), own, 0) == values).all()
    assert (hdf5.decode(values.tobytes(), own, 3) == values).all() and (hdf5.decode(zlib.compress(values.tobytes()), own, 1) == values).all()


def test_steps_take_and_leave_hdf5_runs(spark, tmp_path):
    a, b = (tables_of(spark, [12, 5], seed, pairs=False) for seed in (1, 2))
    b["profile"] = b["profile"].drop("base").join(a["profile"].select("tid", "pos", "base"), ["tid", "pos"]).select(*a["profile"].columns)
    for name, tables in (("a.h5", a), ("b.h5", b)):
        runs.write_run(tables, str(tmp_path / name))
    with pytest.raises(FileExistsError):
        runs.write_run(a, str(tmp_path / "a.h5"))
    first, second = (runs.read_run(spark, str(tmp_path / f"{name}.h5"), "sub") for name in "ab")
    combine.require_agreement(first["profile"], second["profile"])
    made = combine.subtract(first["profile"], second["profile"]).filter("base >= 0 or coverage > 0")
    want = combine.subtract(a["profile"], b["profile"]).filter("base >= 0 or coverage > 0")
    assert runs.same_shape(first, second) and plain(made.select(*sorted(made.columns))) == plain(want.select(*sorted(made.columns)))
    runs.write_run({"profile": made, **runs.combined_counts(first, second)}, str(tmp_path / "c.h5"))
    assert runs.read_run(spark, str(tmp_path / "c.h5"))["run"].first()["unmapped"] == 1 << 41
