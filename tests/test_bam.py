"""BAM files split by blocks: rows of the one-stream reader, whatever the splits."""

import struct
import zlib

import numpy as np
import pytest

from profilewright.sources import bam

CODES = {c: i for i, c in enumerate("=ACMGRSVTWYHKDBN")}


def record(tid, pos, seq, ops, name="r", flag=0, mapq=60, qual=None, extra=b""):
    packed = bytes(CODES[a] << 4 | CODES[b] for a, b in zip(seq[::2], (seq + "=")[1::2], strict=False))
    body = struct.pack("<iiBBHHHiiii", tid, pos, len(name) + 1, mapq, 0, len(ops), flag, len(seq), -1, -1, 0) + name.encode() + b"\0"
    body += b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for n, o in ops) + packed + (qual if qual is not None else b"\xff" * len(seq)) + extra
    return struct.pack("<i", len(body)) + body


def head(n_refs, text=b"@HD\tVN:1.6\tSO:coordinate\n"):
    refs = b"".join(struct.pack("<i", 6) + b"ref%02d\0" % i + struct.pack("<i", 1000 + i) for i in range(n_refs))
    return b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", n_refs) + refs


def block(data, os=255):
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = z.compress(data) + z.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0" + bytes([os]) + b"\x06\0BC\x02\0" + struct.pack("<H", len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(data), len(data))


def bgzf(data, size, os=lambda i: 255):
    return b"".join(block(data[i : i + size], os(i // size)) for i in range(0, len(data), size)) + block(b"")


def reads(n, longest, seed=1):
    rng, out = np.random.default_rng(seed), []
    for i in range(n):
        size = int(rng.integers(0, longest))
        seq = "".join(rng.choice(list("ACGTN"), size))
        qual = None if i % 5 == 0 else bytes(rng.integers(0, 60, size, dtype=np.uint8))
        noise = rng.integers(0, 256, int(rng.integers(0, 40)), dtype=np.uint8).tobytes()
        out.append(record(i * 3 // n if i < n - 5 else -1, i, seq, [(size, "M")] if size else [], f"read{i}", 4 if i >= n - 5 else 0, 60, qual, noise))
    return out


def expected(data):
    stream = bam._Stream(iter([data]))
    bam.header(stream)
    return list(bam.records(stream, 0))


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: r[1])


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k in keys:
        spark.conf.unset(k)


@pytest.mark.parametrize(("longest", "size", "os"), [(200, 3000, 255), (200, 700, 255), (60_000, 9000, 255), (200, 3000, None)])
def test_splits_give_the_rows_of_one_stream(small_splits, tmp_path, monkeypatch, longest, size, os):
    """Short and long records, small and large blocks, records over several splits, blocks whose headers differ."""
    data = head(3) + b"".join(reads(1500 if longest == 200 else 40, longest))
    (tmp_path / "a.bam").write_bytes(bgzf(data, size, lambda i: 255 if os else (255, 3, 0)[i % 3]))
    got = bam.read_bam(small_splits, str(tmp_path / "a.bam"))
    assert rows(got) == expected(data)
    assert got.rdd.getNumPartitions() > 5
    twice = bam.read_bam(small_splits, [str(tmp_path / "a.bam")] * 2)
    assert twice.groupBy("file_id").count().count() == 2 and twice.count() == 2 * len(expected(data))


def test_a_header_over_several_splits(small_splits, tmp_path):
    names = b"".join(b"@CO\t%d %s\n" % (i, bytes(np.random.default_rng(i).integers(65, 90, 50, dtype=np.uint8))) for i in range(2500))
    data = head(3, b"@HD\tVN:1.6\tSO:coordinate\n" + names) + b"".join(reads(600, 300))
    path = str(tmp_path / "h.bam")
    (tmp_path / "h.bam").write_bytes(bgzf(data, 4000))
    assert rows(bam.read_bam(small_splits, path)) == expected(data)
    assert [tuple(r) for r in bam.read_declared(small_splits, path, 2, require_sorted=True).collect()] == [(2, i, f"ref{i:02d}"[:5], 1000 + i, None) for i in range(3)]


@pytest.mark.parametrize("at", [0, 1, 37, 500])
def test_a_first_record_at_a_blocks_border(spark, tmp_path, at):
    data = head(3) + b"".join(reads(30, 100))
    first = len(head(3)) - at
    (tmp_path / "b.bam").write_bytes(block(data[: max(first, 1)]) + block(b"") + bgzf(data[max(first, 1) :], 1000))
    assert rows(bam.read_bam(spark, str(tmp_path / "b.bam"))) == expected(data)


def test_no_records_and_broken_files(small_splits, tmp_path):
    write = lambda name, content: (tmp_path / name).write_bytes(content) and str(tmp_path / name)
    none = bam.read_bam(small_splits, write("none.bam", bgzf(head(2), 1000)))
    assert none.count() == 0
    data = head(3) + b"".join(reads(400, 300))
    with pytest.raises(Exception, match="break off"):
        bam.read_bam(small_splits, write("short.bam", bgzf(data[:-7], 5000))).count()
    spoiled = bytearray(data)
    spoiled[len(data) // 2 : len(data) // 2 + 400] = b"\x7f" * 400
    with pytest.raises(Exception, match="break off|don't meet|unpack|negative"):
        bam.read_bam(small_splits, write("spoiled.bam", bgzf(bytes(spoiled), 5000))).count()
    with pytest.raises(ValueError, match="not a BAM"):
        bam.read_bam(small_splits, write("other.bam", bgzf(b"CRAM" + data, 5000)))


def test_one_gzip_stream_is_read_as_one(spark, tmp_path):
    data = head(3) + b"".join(reads(50, 100))
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    (tmp_path / "g.bam").write_bytes(z.compress(data) + z.flush())
    assert rows(bam.read_bam(spark, str(tmp_path / "g.bam"))) == expected(data)


def test_fields_that_cannot_be_a_records():
    one = reads(1, 100)[0]
    assert bam.plausible(one, 0, 3) == len(one)
    for at, value in ((4, 3), (8, -2), (12, 0), (20, -1), (24, 3), (28, -5)):
        bad = bytearray(one)
        bad[at : at + (1 if at == 12 else 4)] = struct.pack("<b" if at == 12 else "<i", value)
        assert bam.plausible(bytes(bad), 0, 3) == 0
    assert bam.first_record(b"\1" * 50 + one * 3, 3) == 50 and bam.first_record(one, 3) is None
