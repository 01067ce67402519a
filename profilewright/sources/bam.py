"""BAM files, split by their blocks.

Spark's text reader cuts a file at the header that all its blocks begin with, so a file is read in as many tasks as it has splits,
from any file system Spark knows. Records don't begin where blocks do. A first pass looks for a split's first record by its fields,
counts the records from there on, and hands over the bytes before it and those of the unfinished last record; what is left at two
sides of a border must make whole records. As the first record of a file is known from its header, every border that fits proves the
next split's first record. A second pass decodes. A split in which no record can be told belongs to the border around it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import ALIGNMENTS, DECLARED
from ..scratch import materialize
from .runs import fs_path

#: Letters and operations by their codes in the file. Fixed values.
_SEQ, _OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
_COLUMNS = [c.split()[0] for c in ALIGNMENTS.split(", ")]
_HEX_TO_SEQ = str.maketrans("0123456789abcdef", _SEQ)
_PHRED = bytes((q + 33) & 0xFF for q in range(256))
#: Bytes of a block's header before its size, and of a record before its name.
_BLOCK_HEAD, _FIXED = 16, 36
#: Records that must follow each other where a split's first one is looked for, and the least bytes that are looked through.
_CHAIN, _LOOK = 3, 1 << 17
#: Rows and letters that are handed on together.
_ROWS, _LETTERS = 5000, 8 << 20


def inflate(data: bytes, piece: int = 1 << 20) -> Iterator[bytes]:
    """The content of all gzip members, in pieces."""
    at = 0
    view = memoryview(data)
    while at < len(view):
        one, start = zlib.decompressobj(31), at
        while not one.eof and at < len(view):
            out = one.decompress(view[at : at + piece])
            at += piece
            if out:
                yield out
        at = min(at, len(view)) - len(one.unused_data)
        if at <= start:
            raise ValueError("not a BGZF file")


class _Stream:
    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, b""

    def record(self) -> tuple[bytes, bool]:
        """The next record with its length field, or the bytes left and False."""
        size = self.take(4)
        if len(size) < 4:
            return size, False
        n = struct.unpack("<i", size)[0]
        if n < _FIXED - 4:
            raise ValueError(f"records break off: one of {n} bytes")
        data = size + self.take(n)
        return data, len(data) == n + 4

    def take(self, n: int) -> bytes:
        """The next ``n`` bytes, or what there is."""
        if len(self.held) < n:
            parts, have = [self.held], len(self.held)
            while have < n and (piece := next(self.pieces, b"")):
                parts.append(piece)
                have += len(piece)
            self.held = b"".join(parts)
        out, self.held = self.held[:n], self.held[n:]
        return out


def header(stream: _Stream) -> tuple[str, list[tuple[str, int]]]:
    """The text of the header, and the references by name and length."""
    if stream.take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    text = stream.take(struct.unpack("<i", stream.take(4))[0]).rstrip(b"\0").decode()
    refs = []
    for _ in range(struct.unpack("<i", stream.take(4))[0]):
        name = stream.take(struct.unpack("<i", stream.take(4))[0])[:-1].decode()
        refs.append((name, struct.unpack("<i", stream.take(4))[0]))
    return text, refs


@dataclass
class Entry:
    """Where a file's records begin: the marks (checksum and sizes) of the header's blocks and of the block with the first record, and its place in that; ``separator`` is what all blocks begin with, None if the file is one gzip stream."""

    text: str
    refs: list[tuple[str, int]]
    separator: bytes | None
    marks: list[tuple[int, int, int]]
    at: int


def _mark(block: bytes) -> tuple[int, int, int]:
    return (*struct.unpack("<II", block[-8:]), len(block))


def read_entry(spark: SparkSession, path: str) -> Entry:
    """Read the header on the driver, block by block, and no further than the first record."""
    fs, p = fs_path(spark, path)
    source = fs.open(p)
    try:
        marks, sizes, start = [], [], b""

        def pieces() -> Iterator[bytes]:
            nonlocal start
            while head := bytes(source.readNBytes(_BLOCK_HEAD + 2)):
                if head[:4] != b"\x1f\x8b\x08\x04" or head[10:16] != b"\x06\0BC\x02\0":
                    if marks:
                        raise ValueError(f"{path}: not a BGZF block")
                    source.seek(0)
                    yield from inflate(bytes(source.readAllBytes()))  # one gzip stream: it can't be split, and is read the same way by a task
                    return
                start = start or head[:_BLOCK_HEAD]
                block = head + bytes(source.readNBytes(struct.unpack("<H", head[16:18])[0] + 1 - len(head)))
                content = zlib.decompress(block, 31)
                if content:
                    marks.append(_mark(block)), sizes.append(len(content))
                    yield content

        stream = _Stream(pieces())
        text, refs = header(stream)
        at = sizes[-1] - len(stream.held) if sizes else 0
        if sizes and not stream.held and next(stream.pieces, b""):  # the first record is the next block's first
            at = 0
        return Entry(text, refs, start or None, marks, at)
    finally:
        source.close()


def read_header(spark: SparkSession, path: str, file_id: int = 0) -> DataFrame:
    """``file_id, tid, name, len, m5, is_sorted``: the references that a BAM file declares, and whether its header's first line says exactly ``SO:coordinate``. Checksums stand in the text alone, under the same names."""
    entry = read_entry(spark, path)
    lines = [line.rstrip("\r").split("\t") for line in entry.text.split("\n")]
    is_sorted = lines[0][0] == "@HD" and "SO:coordinate" in lines[0]
    tags = [dict(f.split(":", 1) for f in line[1:] if ":" in f) for line in lines if line[0] == "@SQ"]
    sums = {t["SN"]: t["M5"] for t in tags if "SN" in t and "M5" in t}
    rows = [(file_id, k, name, size, sums.get(name), is_sorted) for k, (name, size) in enumerate(entry.refs)]
    return spark.createDataFrame(rows, DECLARED + ", is_sorted boolean")


def read_declared(spark: SparkSession, path: str, file_id: int = 0, require_sorted: bool = False) -> DataFrame:
    """``declared``: the references of a BAM file, as ``text.read_declared`` has those of a SAM file."""
    found = read_header(spark, path, file_id)
    if require_sorted and found.filter(~F.col("is_sorted")).head(1):
        raise ValueError(f"{path}: not sorted by coordinate")
    return found.drop("is_sorted")


def plausible(data: bytes, at: int, n_refs: int) -> int:
    """The size of the record whose fixed part stands at ``at``, with its length field; 0 if these can't be a record's fields."""
    size, tid, pos, l_name, _, _, n_cigar, _, l_seq, next_tid, next_pos = struct.unpack_from("<iiiBBHHHiii", data, at)
    if not (-1 <= tid < n_refs and -1 <= next_tid < n_refs and pos >= -1 and next_pos >= -1 and l_name and l_seq >= 0):
        return 0
    if size < 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq:
        return 0
    name = data[at + _FIXED : at + _FIXED + l_name]
    if len(name) == l_name and (name[-1] or not all(33 <= c <= 126 for c in name[:-1])):
        return 0
    ops = at + _FIXED + l_name
    if len(data) >= ops + 4 * n_cigar and any(o & 15 > 8 for o in struct.unpack_from(f"<{n_cigar}I", data, ops)):
        return 0
    return size + 4


def first_record(data: bytes, n_refs: int) -> int | None:
    """Where a record begins that plausible ones follow; None if nothing in the data is sure."""
    for at in range(len(data) - _FIXED + 1):
        to = at
        for _ in range(_CHAIN):
            if to + _FIXED > len(data) or not (size := plausible(data, to, n_refs)):
                break
            to += size
        else:
            return at
    return None


def _split_rows(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for frame in frames:
        yield from frame.itertuples(index=False)


def _contents(lines: Iterator[bytes], entry: Entry) -> tuple[bool, Iterator[bytes]]:
    """The content of a split's blocks, without the header; and whether the first piece is the block with the file's first record."""

    def blocks() -> Iterator[bytes]:
        for line in lines:
            data, at = entry.separator + line, 0
            while at < len(data) - _BLOCK_HEAD:  # a block with another header is not cut off from the one before
                size = struct.unpack_from("<H", data, at + _BLOCK_HEAD)[0] + 1
                yield data[at : at + size]
                at += size

    filled = (b for b in blocks() if struct.unpack("<I", b[-4:])[0])
    first = next(filled, None)
    if first is None:
        return False, iter(())
    rest = chain([first], filled)
    known = _mark(first) in entry.marks
    if known:
        for _ in range(len(entry.marks) - 1 - entry.marks.index(_mark(first))):
            next(rest, None)
    return known, (zlib.decompress(b, 31) for b in rest)


def look_at_borders(entry: Entry, look: int = _LOOK) -> Callable:
    """Lines of one file to a row a split: whether a record begins in it, after how many bytes, how many end in it, and the bytes before and after those."""
    n_refs = len(entry.refs)

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block, lines in groupby(_split_rows(frames), lambda r: r.block):
            known, pieces = _contents((r.value for r in lines), entry)
            held, start, grown = b"", entry.at if known else None, look
            while start is None and (piece := next(pieces, b"")):
                parts, have = [held, piece], len(held) + len(piece)
                while have < grown and (piece := next(pieces, b"")):
                    parts.append(piece)
                    have += len(piece)
                held, grown = b"".join(parts), 2 * have
                start = first_record(held, n_refs)
            if start is None:
                yield pd.DataFrame([(block, False, 0, 0, held, b"")], columns=["block", "has", "skip", "n", "head", "tail"])
                continue
            stream, n = _Stream(pieces), 0
            stream.held = held
            head = stream.take(start)
            while (found := stream.record())[1]:
                n += 1
            yield pd.DataFrame([(block, True, start, n, b"" if known else head, found[0])], columns=["block", "has", "skip", "n", "head", "tail"])

    return rows


def stitched(path: str, n_refs: int) -> Callable:
    """The bytes around a border, by split, to one row with as many whole records."""

    def join(parts: pd.DataFrame) -> pd.DataFrame:
        data, at, n = b"".join(parts.sort_values("block")["part"]), 0, 0
        while at + _FIXED <= len(data) and (size := plausible(data, at, n_refs)):
            at, n = at + size, n + 1
        if at != len(data):
            raise ValueError(f"{path}: records break off or don't meet between blocks")
        return pd.DataFrame([(parts["border"].iloc[0], n, data)], columns=["border", "n", "data"])

    return join


def records(stream: _Stream, file_id: int, first: int = 0, most: int | None = None) -> Iterator[tuple]:
    n = 0
    while n != most and (found := stream.record())[1]:
        data = found[0]
        tid, pos, l_name, mapq, _, n_cigar, flag, l_seq = struct.unpack_from("<iiBBHHHi", data, 4)
        at = _FIXED + l_name
        ops = struct.unpack(f"<{n_cigar}I", data[at : at + 4 * n_cigar])
        at += 4 * n_cigar
        packed, qual = data[at : at + (l_seq + 1) // 2], data[at + (l_seq + 1) // 2 : at + (l_seq + 1) // 2 + l_seq]
        seq = packed.hex().translate(_HEX_TO_SEQ)[:l_seq] or None
        quality = None if not qual or qual[0] == 0xFF else qual.translate(_PHRED).decode("latin-1")
        yield file_id, first + n, tid, pos, flag, mapq, "".join(f"{o >> 4}{_OPS[o & 15]}" for o in ops) or "*", seq, quality, l_seq
        n += 1


def _frames(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    held, letters = [], 0
    for row in rows:
        held.append(row)
        letters += row[-1]
        if len(held) >= _ROWS or letters >= _LETTERS:
            yield pd.DataFrame(held, columns=_COLUMNS)
            held, letters = [], 0
    if held:
        yield pd.DataFrame(held, columns=_COLUMNS)


def read_one(spark: SparkSession, path: str, file_id: int = 0) -> DataFrame:
    """``alignments`` of one BAM file, numbered as they stand; a task a split."""
    entry = read_entry(spark, path)
    if entry.separator is None:

        def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for content in chain.from_iterable(f["content"] for f in frames):
                stream = _Stream(inflate(content))
                header(stream)
                yield from _frames(records(stream, file_id))

        return spark.read.format("binaryFile").load(path).select("content").mapInPandas(whole, ALIGNMENTS)
    cut = spark.read.options(lineSep=entry.separator.decode("latin-1"), encoding="ISO-8859-1").text(path)
    lines = cut.select(F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value")).filter(F.length("value") > 0)
    slim = Entry("", entry.refs, entry.separator, entry.marks, entry.at)
    found = materialize(lines.mapInPandas(look_at_borders(slim), "block long, has boolean, skip long, n long, head binary, tail binary"), "bam-borders")
    # A row a split: the border after the k-th split that has a record is border k.
    places = found.select("block", "has").withColumn("border", F.sum(F.col("has").cast("int")).over(Window.orderBy("block")))
    placed = found.join(F.broadcast(places.drop("has")), "block")
    part = lambda k, c: F.struct((F.col("border") - k).alias("border"), F.col(c).alias("part"))
    pieces = placed.select("block", F.explode(F.array(part(F.col("has").cast("int"), "head"), part(0, "tail"))).alias("p")).select("block", "p.*").filter(F.length("part") > 0)
    borders = materialize(pieces.groupBy("border").applyInPandas(stitched(path, len(entry.refs)), "border long, n long, data binary"), "bam-stitched")
    counts = placed.filter("has").select("border", F.lit(0).alias("k"), "n").unionByName(borders.select("border", F.lit(1).alias("k"), "n"))
    before = F.sum("n").over(Window.orderBy("border", "k").rowsBetween(Window.unboundedPreceding, -1))
    numbers = counts.select("border", "k", "n", F.coalesce(before, F.lit(0)).alias("first"))
    of_splits = placed.filter("has").select("block", "border", "skip").join(numbers.filter("k = 0").drop("k"), "border").select("block", "skip", "n", "first")

    def decoded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, lines in groupby(_split_rows(frames), lambda r: r.block):
            one = next(lines)
            stream = _Stream(_contents((r.value for r in chain([one], lines)), slim)[1])
            stream.take(one.skip)
            yield from _frames(records(stream, file_id, one.first, one.n))

    def bordering(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in _split_rows(frames):
            yield from _frames(records(_Stream(iter([row.data])), file_id, row.first, row.n))

    inside = lines.join(F.broadcast(of_splits), "block").mapInPandas(decoded, ALIGNMENTS)
    return inside.unionByName(borders.join(F.broadcast(numbers.filter("k = 1").select("border", "first")), "border").mapInPandas(bordering, ALIGNMENTS))


def read_bam(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """``alignments`` of BAM files, the same file twice counting twice; CRAM is refused."""
    paths = [paths] if isinstance(paths, str) else paths
    if any(p.endswith(".cram") for p in paths):
        raise ValueError("CRAM cannot be read here; convert it to BAM or SAM")
    parts = None
    for file_id, path in enumerate(paths):
        part = read_one(spark, path, file_id)
        parts = part if parts is None else parts.unionByName(part)
    return parts
