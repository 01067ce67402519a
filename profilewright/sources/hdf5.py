"""Profiles in HDF5 files of the common layout: fields as chunked datasets, byte-shuffled and deflated, indexed by version 1 B-trees.

The driver reads what describes the file: groups, headers, and a row a chunk of where its bytes lie. The bytes themselves are read by
Spark's text reader, which splits a file of any file system; a split's place in the file follows from the sizes of the splits before.
A task decodes the chunks that lie in its split, and chunks that cross a border are put together from their parts.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FILLS, nan
from ..scratch import materialize
from .runs import fs_path, is_taken

#: Fields of the layout by table and column. Name, dimensions (n references, l longest, 2l, or one value), type.
FIELDS = {
    "coverage": ("profile", "coverage", "nl", "<f4"), "reactivity": ("profile", "reactivity", "nl", "<f4"), "error": ("profile", "error", "nl", "<f4"), "sequence": ("profile", "base", "nl", "|i1"),
    "reads/lengths": ("lengths", "n", "n2", "<u8"), "reads/counted": ("ref_stats", "counted", "n", "<u8"), "reads/rejected": ("ref_stats", "rejected", "n", "<u8"), "reads/unmapped": ("run", "unmapped", "", "<u8"), "norm": ("run", "norm", "", "<f4"),
    "pairwise/correlation": ("pairs", "correlation", "nll", "<f4"), "pairwise/conditional": ("pairs", "conditional", "nll", "<f4"), "pairwise/coverage": ("pairs", "coverage", "nll", "<f4"),
}
#: Bytes of a chunk before compression, about; side of a square of pairs; level of compression.
CHUNK_BYTES, SQUARE, LEVEL = 1 << 20, 256, 3
_SIGNATURE, _NONE = b"\x89HDF\r\n\x1a\n", 0xFFFFFFFFFFFFFFFF
_LEAF_K, _GROUP_K, _CHUNK_K = 4, 16, 32
_FILTERS = {1: "deflate", 2: "shuffle", 3: "checksum", 4: "szip", 5: "nbit", 6: "scale-offset"}


@dataclass
class Dataset:
    """What a dataset's header says; a contiguous one lies at ``address``, a chunked one has its index there."""

    dims: tuple[int, ...]
    dtype: str
    address: int = _NONE
    chunk: tuple[int, ...] | None = None
    filters: tuple[int, ...] = ()


class _File:
    """Random reads of a file's descriptions on the driver."""

    def __init__(self, spark: SparkSession, path: str):
        fs, p = fs_path(spark, path)
        self.path, self.stream = path, fs.open(p)

    def read(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        data = bytes(self.stream.readNBytes(n))
        if len(data) < n:
            raise ValueError(f"{self.path}: the file breaks off")
        return data

    def numbers(self, form: str, at: int) -> tuple:
        return struct.unpack(form, self.read(at, struct.calcsize(form)))

    def root(self) -> int:
        head = self.read(0, 96)
        if head[:8] != _SIGNATURE:
            raise ValueError(f"{self.path}: not an HDF5 file")
        if head[8] > 1 or head[13] != 8 or head[14] != 8:
            raise ValueError(f"{self.path}: superblock version {head[8]} is not read here")
        return struct.unpack_from("<Q", head, 64 + 4 * head[8])[0]

    def messages(self, at: int) -> Iterator[tuple[int, bytes]]:
        """Type and content of the messages of an object's header."""
        version, _, count, _, size = self.numbers("<BBHII", at)
        if version != 1:
            raise ValueError(f"{self.path}: object headers of version {version} are not read here")
        blocks = [self.read(at + 16, size)]
        while blocks and count:
            block, k = blocks.pop(0), 0
            while k + 8 <= len(block) and count:
                kind, n = struct.unpack_from("<HH", block, k)
                body, k, count = block[k + 8 : k + 8 + n], k + 8 + n, count - 1
                if kind == 0x10:
                    blocks.append(self.read(*struct.unpack("<QQ", body[:16])))
                else:
                    yield kind, body

    def tree(self, at: int, key: int) -> Iterator[tuple[bytes, int]]:
        """Key and child of all leaves of a B-tree, in order."""
        if at == _NONE:
            return
        mark, _, level, used = self.numbers("<4sBBH", at)
        if mark != b"TREE":
            raise ValueError(f"{self.path}: no index at {at}")
        body = self.read(at + 24, used * (key + 8) + key)
        for i in range(used):
            k = i * (key + 8)
            child = struct.unpack_from("<Q", body, k + key)[0]
            if level:
                yield from self.tree(child, key)
            else:
                yield body[k : k + key], child

    def members(self, at: int) -> dict[str, int]:
        """Header addresses by name in a group."""
        tables = [struct.unpack("<QQ", body[:16]) for kind, body in self.messages(at) if kind == 0x11]
        out = {}
        for tree, heap in tables:
            size, _, names = self.numbers("<QQQ", heap + 8)
            heap_data = self.read(names, size)
            for _, node in self.tree(tree, 8):
                count = self.numbers("<4sBBH", node)[3]
                for i in range(count):
                    offset, header = self.numbers("<QQ", node + 8 + 40 * i)
                    out[heap_data[offset : heap_data.index(b"\0", offset)].decode()] = header
        return out

    def attributes(self, at: int) -> dict[str, str]:
        """String attributes of an object."""
        out = {}
        for kind, body in self.messages(at):
            if kind == 0x0C and body[0] == 1:
                sizes = struct.unpack_from("<HHH", body, 2)
                ends = np.cumsum([8] + [-(-n // 8) * 8 for n in sizes])
                name = body[8 : 8 + sizes[0]].rstrip(b"\0").decode()
                if body[ends[1]] & 15 == 3:
                    out[name] = body[ends[3] : ends[3] + struct.unpack_from("<I", body, int(ends[1]) + 4)[0]].rstrip(b"\0").decode()
        return out

    def dataset(self, at: int, name: str) -> Dataset:
        out = Dataset((), "")
        for kind, body in self.messages(at):
            if kind == 0x01:
                rank, begin = body[1], 8 if body[0] == 1 else 4
                out.dims = struct.unpack_from(f"<{rank}Q", body, begin)
            elif kind == 0x03:
                size, big, signed = struct.unpack_from("<I", body, 4)[0], body[1] & 1, body[1] & 8
                if big or body[0] & 15 > 1:
                    raise ValueError(f"{self.path}: {name} has a type that is not read here")
                out.dtype = f"<f{size}" if body[0] & 15 else f"<{'i' if signed else 'u'}{size}"
            elif kind == 0x08:
                if body[0] != 3 or body[1] not in (1, 2):
                    raise ValueError(f"{self.path}: {name} is stored in a way that is not read here")
                if body[1] == 1:
                    out.address = struct.unpack_from("<Q", body, 2)[0]
                else:
                    rank = body[2] - 1
                    out.address, out.chunk = struct.unpack_from("<Q", body, 3)[0], struct.unpack_from(f"<{rank}I", body, 11)
            elif kind == 0x0B:
                k, found = (8, []) if body[0] == 1 else (2, [])
                for _ in range(body[1]):
                    number, length, _, values = struct.unpack_from("<HHHH", body, k)
                    if number not in (1, 2):
                        raise ValueError(f"{self.path}: {name} uses the filter {_FILTERS.get(number, number)}, which is not read here")
                    k += 8 + -(-length // 8) * 8 + 4 * (values + (values & 1)) if body[0] == 1 else 6 + 4 * struct.unpack_from("<H", body, k + 4)[0]
                    found.append(number)
                out.filters = tuple(found)
        return out


@dataclass
class Layout:
    """A file's fields, its chunks as ``field, at, size, mask, offsets``, attributes and single values."""

    fields: dict[str, Dataset]
    chunks: pd.DataFrame
    attributes: dict[str, str]
    values: dict[str, float]


def read_layout(spark: SparkSession, path: str) -> Layout:
    """Read on the driver what describes the file: a row a chunk at most. Fields that the layout doesn't know are passed over."""
    file = _File(spark, path)
    try:
        root = file.root()
        found = file.members(root)
        for group in {name.split("/")[0] for name in FIELDS if "/" in name} & set(found):
            found |= {f"{group}/{name}": at for name, at in file.members(found[group]).items()}
        fields = {name: file.dataset(found[name], name) for name in FIELDS if name in found}
        if "coverage" not in fields or len(fields["coverage"].dims) != 2:
            raise ValueError(f"{path}: no field coverage with a row a reference")
        n, cap = fields["coverage"].dims
        rows, values = [], {}
        for name, own in fields.items():
            if own.dims != shape(name, n, cap):
                raise ValueError(f"{path}: {name} does not agree with the shape of the file")
            if not own.dims:
                values[name] = np.frombuffer(file.read(own.address, np.dtype(own.dtype).itemsize), own.dtype)[0].item() if own.address != _NONE else FILLS[FIELDS[name][1]]
            elif own.chunk is None:
                # Stored in one piece: taken as chunks of whole rows, none of which is compressed.
                row = int(np.prod(own.dims[1:])) * np.dtype(own.dtype).itemsize
                own.chunk = (min(own.dims[0], max(1, CHUNK_BYTES // row)), *own.dims[1:])
                for first in range(0, own.dims[0] if own.address != _NONE else 0, own.chunk[0]):
                    rows.append((name, own.address + first * row, min(own.chunk[0], own.dims[0] - first) * row, 0xFFFFFFFF, [first] + [0] * (len(own.dims) - 1)))
            else:
                for key, at in file.tree(own.address, 8 + 8 * (len(own.dims) + 1)):
                    size, mask, *offsets = struct.unpack(f"<II{len(own.dims)}Q", key[:-8])
                    rows.append((name, at, size, mask, offsets))
        chunks = pd.DataFrame(rows, columns=["field", "at", "size", "mask", "offsets"]).sort_values("at", ignore_index=True)
        return Layout(fields, chunks[chunks["at"] != _NONE], file.attributes(root), values)
    finally:
        file.stream.close()


def shape(name: str, n: int, cap: int) -> tuple[int, ...]:
    return {"nl": (n, cap), "n2": (n, 2 * cap), "n": (n,), "": (), "nll": (n, cap, cap)}[FIELDS[name][2]]


def decode(data: bytes, own: Dataset, mask: int) -> np.ndarray:
    """A chunk's values; filters whose bit is set in the mask were left out."""
    kind = np.dtype(own.dtype)
    for i in reversed(range(len(own.filters))):
        if not mask >> i & 1:
            data = zlib.decompress(data) if own.filters[i] == 1 else np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1).T.tobytes()
    return np.frombuffer(data, kind).reshape(-1, *own.chunk[1:])


def encode(values: np.ndarray) -> bytes:
    return zlib.compress(np.frombuffer(values.tobytes(), np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes(), LEVEL)


_LINES = "field string, tid int, i int, first int, f array<float>, n array<bigint>"
_PARTS = _LINES + ", chunk int, at bigint, part binary"


def lines_of(values: np.ndarray, own: Dataset, name: str, offsets: list[int]) -> Iterator[tuple]:
    """The chunk's rows along its last dimension, without what reaches over the field's ends."""
    kept = values[tuple(slice(0, d - o) for d, o in zip(own.dims, offsets, strict=True))]
    first = offsets[-1]
    for place in np.ndindex(kept.shape[:-1]):
        at = [int(o + k) for o, k in zip(offsets, place, strict=False)] + [None, None]
        row = kept[place]
        yield name, at[0], at[1], int(first), *((row, None) if row.dtype.kind == "f" else (None, row.astype(np.int64)))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    """Stretches of a split's bytes, with the split's place among the text reader's."""
    for batch in batches:
        blocks, values, k = batch.column("block").to_pylist(), batch.column("value").to_pylist(), 0
        for block, same in groupby(blocks):
            n = sum(1 for _ in same)
            yield block, b"\n".join(values[k : k + n]) + b"\n"
            k += n


def decode_splits(layout: Layout, starts: dict[int, int]) -> Callable:
    """Lines of the file to the rows of the chunks that a split has whole, and the parts of others."""
    address, size = layout.chunks["at"].to_numpy(np.int64), layout.chunks["size"].to_numpy(np.int64)
    names, masks, offsets = (layout.chunks[c].tolist() for c in ("field", "mask", "offsets"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for block, pieces in groupby(_runs(batches), lambda r: r[0]):
            begin = starts[block]
            k, held = int(np.searchsorted(address + size, begin, side="right")), b""  # the first chunk that ends in or after the split
            for _, piece in pieces:
                held, out = held + piece, []
                while k < len(address) and address[k] + size[k] <= begin + len(held):
                    from_ = int(address[k]) - begin
                    if from_ >= 0:
                        out += [(*r, None, None, None) for r in lines_of(decode(held[from_ : from_ + int(size[k])], layout.fields[names[k]], masks[k]), layout.fields[names[k]], names[k], offsets[k])]
                    else:
                        out.append((None,) * 6 + (k, begin, held[: from_ + int(size[k])]))
                    k += 1
                keep = len(held) if k == len(address) else min(len(held), max(0, int(address[k]) - begin))
                begin, held = begin + keep, held[keep:]
                if out:
                    yield pd.DataFrame(out, columns=[c.split()[0] for c in _PARTS.split(", ")])
            if held and k < len(address) and address[k] < begin + len(held):
                yield pd.DataFrame([(None,) * 6 + (k, begin, held)], columns=[c.split()[0] for c in _PARTS.split(", ")])

    def arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in rows(batches):
            yield pa.RecordBatch.from_pandas(frame, schema=_arrow_schema(), preserve_index=False)

    return arrow


def _arrow_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "array<float>": pa.list_(pa.float32()), "array<bigint>": pa.list_(pa.int64()), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _PARTS.split(", ")])


def read_lines(spark: SparkSession, path: str, layout: Layout) -> DataFrame:
    """``field, tid, i, first, f, n``: stretches of every field's values, from every chunk of the file."""
    text = spark.read.option("lineSep", "\n").text(path)
    lines = text.select(F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    sizes = lines.groupBy("block").agg(F.sum(F.octet_length("value") + 1).alias("n")).orderBy("block").collect()  # a row a split
    starts, at = {}, 0
    for r in sizes:
        starts[r["block"]], at = at, at + r["n"]
    found = materialize(lines.mapInArrow(decode_splits(layout, starts), _PARTS), "hdf5")

    def joined(parts: pd.DataFrame) -> pd.DataFrame:
        row = layout.chunks.iloc[parts["chunk"].iloc[0]]
        parts = parts.sort_values("at")
        data = b"".join(parts["part"])
        begin = int(row["at"]) - int(parts["at"].iloc[0])
        own = layout.fields[row["field"]]
        return pd.DataFrame(list(lines_of(decode(data[begin : begin + int(row["size"])], own, row["mask"]), own, row["field"], row["offsets"])), columns=[c.split()[0] for c in _LINES.split(", ")])

    whole = found.filter("chunk is null").select(*(c.split()[0] for c in _LINES.split(", ")))
    return whole.unionByName(found.filter("chunk is not null").groupBy("chunk").applyInPandas(joined, _LINES))


def read_hdf5(spark: SparkSession, path: str, references: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of a run, as ``runs.read_run`` has them. The file has neither names nor lengths: with ``references`` the profile has their positions alone, else all up to the longest, and names and lengths are null."""
    layout = read_layout(spark, path)
    n, cap = layout.fields["coverage"].dims
    lines, fields = read_lines(spark, path, layout), layout.fields
    def cells(name: str) -> DataFrame:
        spelled = F.posexplode("f" if fields[name].dtype[1] == "f" else "n").alias("k", "value")
        found = lines.filter(F.col("field") == name).select("tid", "i", "first", spelled).withColumn("at", F.col("first") + F.col("k"))
        return found.withColumn("value", F.coalesce("value", nan("float"))) if fields[name].dtype[1] == "f" else found  # pandas hands NaN on as null

    def pivoted(table: str, keys: dict[str, str]) -> DataFrame | None:
        """A row a key, a column a field."""
        parts = [(FIELDS[name][1], cells(name)) for name in fields if FIELDS[name][0] == table and fields[name].dims]
        if not parts:
            return None
        columns = [c for c, _ in parts]
        rows = reduce(DataFrame.unionByName, [df.select(*(F.col(at).alias(k) for k, at in keys.items()), *(F.col("value").alias(c) if c == own else F.lit(None).cast(dict(part.dtypes)["value"]).alias(c) for c, part in parts)) for own, df in parts])
        return rows.groupBy(*keys).agg(*(F.max(c).alias(c) for c in columns))

    profile = pivoted("profile", {"tid": "tid", "pos": "at"})
    refs = spark.range(n).select(F.col("id").cast("int").alias("tid"))
    lengths = refs.join(references.select("tid", "name", "len"), "tid", "left") if references is not None else refs.withColumns({"name": F.lit(None).cast("string"), "len": F.lit(None).cast("int")})
    every = lengths.select("tid", F.explode(F.sequence(F.lit(0), F.coalesce("len", F.lit(cap)) - 1)).alias("pos")).filter("pos >= 0")
    types = {"base": "tinyint"}
    filled = lambda c, kind: F.coalesce(F.col(c), F.lit(FILLS[c])).cast(kind).alias(c)
    out = {"profile": every.join(profile, ["tid", "pos"], "left").select("tid", "pos", *(filled(c, types.get(c, "float")) for c in ("base", "coverage", "reactivity", "error") if c in profile.columns))}
    stats = pivoted("ref_stats", {"tid": "at"})
    if stats is not None:
        out["ref_stats"] = lengths.join(stats, "tid", "left").select("tid", "name", "len", *(filled(c, "bigint") for c in ("counted", "rejected") if c in stats.columns))
    histogram = pivoted("lengths", {"tid": "tid", "length": "at"})
    if histogram is not None:
        out["lengths"] = histogram.filter("n > 0").select("tid", (F.col("length") + 1).alias("length"), "n")
    pairs = pivoted("pairs", {"tid": "tid", "i": "i", "j": "at"})
    if pairs is not None:
        written = lambda c: ~F.isnan(c) if math.isnan(FILLS[c]) else F.col(c) != FILLS[c]
        out["pairs"] = pairs.filter(reduce(Column.__or__, [written(c) for c in pairs.columns[3:]]))
    run = {"program": layout.attributes.get("program"), "version": layout.attributes.get("version"), "n_refs": n, "cap": cap, "unmapped": layout.values.get("reads/unmapped", 0), "norm": layout.values.get("norm", float("nan"))}
    out["run"] = spark.createDataFrame([tuple(run.values())], "program string, version string, n_refs int, cap int, unmapped bigint, norm float")
    return out


# --- writing -------------------------------------------------------------------------------------------------------------------


def chunk_shape(name: str, dims: tuple[int, ...]) -> tuple[int, ...]:
    """As many whole rows as make about ``CHUNK_BYTES``, and of longer rows a stretch; pairs in squares."""
    values = CHUNK_BYTES // np.dtype(FIELDS[name][3]).itemsize
    if FIELDS[name][2] == "nll":
        return (1, min(dims[1], SQUARE), min(dims[2], SQUARE))
    wide = min(dims[-1], values)
    return (wide,) if len(dims) == 1 else (max(1, min(dims[0], values // wide)), wide)


def _message(kind: int, body: bytes) -> bytes:
    body += bytes(-len(body) % 8)
    return struct.pack("<HHB3x", kind, len(body), 0) + body


def _header(messages: list[bytes]) -> bytes:
    body = b"".join(messages)
    return struct.pack("<BBHII4x", 1, 0, len(messages), 1, len(body)) + body


def _type(dtype: str) -> bytes:
    kind = np.dtype(dtype)
    if kind.kind == "f":
        return struct.pack("<4BIHH4BI", 0x11, 0x20, 0x1F, 0, 4, 0, 32, 23, 8, 0, 23, 127)
    return struct.pack("<4BIHH", 0x10, 8 if kind.kind == "i" else 0, 0, 0, kind.itemsize, 0, 8 * kind.itemsize)


def _space(dims: tuple[int, ...]) -> bytes:
    return struct.pack(f"<BBBB4x{len(dims)}Q", 1, len(dims), 0, 0, *dims)


def _attribute(name: str, value: str) -> bytes:
    label, text, padded = name.encode() + b"\0", value.encode() or b"\0", lambda b: b + bytes(-len(b) % 8)
    return _message(0x0C, struct.pack("<BBHHH", 1, 0, len(label), 8, 8) + padded(label) + struct.pack("<4BI", 0x13, 0, 0, 0, len(text)) + _space(()) + text)


class _Image:
    """The descriptions, laid out from the file's start on."""

    def __init__(self):
        self.data = bytearray(96)

    def add(self, part: bytes) -> int:
        at = len(self.data)
        self.data += part + bytes(-len(part) % 8)
        return at

    def tree(self, kind: int, entries: list[tuple[bytes, int]], last: bytes, k: int) -> int:
        """A B-tree over keys and children, bottom up; ``last`` is the key after all."""
        level, size = 0, 24 + (2 * k + 1) * len(last) + 16 * k
        while True:
            groups = [entries[i : i + 2 * k] for i in range(0, len(entries), 2 * k)] or [[]]
            first = len(self.data)
            at = [first + i * (size + -size % 8) for i in range(len(groups))]
            for i, group in enumerate(groups):
                after = groups[i + 1][0][0] if i + 1 < len(groups) else last
                body = b"".join(key + struct.pack("<Q", child) for key, child in group) + after
                sides = at[i - 1] if i else _NONE, at[i + 1] if i + 1 < len(groups) else _NONE
                self.add((struct.pack("<4sBBHQQ", b"TREE", kind, level, len(group), *sides) + body).ljust(size, b"\0"))
            if len(groups) == 1:
                return first
            entries, level = [(g[0][0], a) for g, a in zip(groups, at, strict=True)], level + 1

    def group(self, members: dict[str, int], attributes: list[bytes]) -> tuple[int, int, int]:
        """A group's header, tree and heap."""
        names, offsets = b"\0" * 8, {}
        for name in sorted(members):
            offsets[name] = len(names)
            names += name.encode() + b"\0" + bytes(-(len(name) + 1) % 8)
        entries = b"".join(struct.pack("<QQI4x16x", offsets[n], members[n], 0) for n in sorted(members))
        leaf = self.add((struct.pack("<4sBBH", b"SNOD", 1, 0, len(members)) + entries).ljust(8 + 80 * _LEAF_K, b"\0"))
        heap = self.add(struct.pack("<4sB3xQQQ", b"HEAP", 0, len(names), 1, self.add(names)))
        tree = self.tree(0, [(struct.pack("<Q", 0), leaf)], struct.pack("<Q", max(offsets.values(), default=0)), _GROUP_K)
        return self.add(_header([_message(0x11, struct.pack("<QQ", tree, heap)), *attributes])), tree, heap


def described(shapes: dict[str, tuple[int, ...]], chunks: dict[str, list[tuple[tuple[int, ...], int]]], values: dict[str, float], attributes: dict[str, str], base: int) -> bytes:
    """The file's descriptions when the chunks follow each other from ``base`` on."""
    image, headers, at = _Image(), {}, base
    for name, dims in shapes.items():
        column, dtype = FIELDS[name][1], FIELDS[name][3]
        kind = np.dtype(dtype)
        fill = np.array(FILLS.get(column, 0), kind).tobytes()
        messages = [_message(0x01, _space(dims)), _message(0x03, _type(dtype)), _message(0x05, struct.pack("<4BI", 2, 3 if dims else 2, 0, 1, len(fill)) + fill)]
        if dims:
            chunk, entries = chunk_shape(name, dims), []
            key = lambda offsets, size: struct.pack(f"<II{len(offsets)}QQ", size, 0, *offsets, 0)
            for offsets, size in chunks[name]:
                entries.append((key(offsets, size), at))
                at += size
            top = chunks[name][-1][0] if chunks[name] else (0,) * len(dims)
            tree = image.tree(1, entries, key((top[0] + chunk[0], *top[1:]), 0), _CHUNK_K) if entries else _NONE
            messages.append(_message(0x08, struct.pack(f"<BBBQ{len(chunk)}II", 3, 2, len(chunk) + 1, tree, *chunk, kind.itemsize)))
            one = lambda number, label, value: struct.pack("<HHHH8sI4x", number, 8, 1, 1, label, value)
            messages.append(_message(0x0B, struct.pack("<BB6x", 1, 2) + one(2, b"shuffle", kind.itemsize) + one(1, b"deflate", LEVEL)))
        else:
            place = image.add(np.array(values[name], kind).tobytes())
            messages.append(_message(0x08, struct.pack("<BBQQ", 3, 1, place, kind.itemsize)))
        headers[name] = image.add(_header(messages))
    groups = {}
    for name, header in headers.items():
        head, _, tail = name.rpartition("/")
        groups.setdefault(head, {})[tail] = header
    for name in [g for g in groups if g]:
        groups.setdefault("", {})[name] = image.group(groups[name], [])[0]
    root, tree, heap = image.group(groups.get("", {}), [_attribute(k, v) for k, v in attributes.items()])
    head = _SIGNATURE + struct.pack("<8BHHI", 0, 0, 0, 0, 0, 8, 8, 0, _LEAF_K, _GROUP_K, 0)
    total = at if base else len(image.data)
    image.data[:96] = head + struct.pack("<QQQQ", 0, _NONE, total, _NONE) + struct.pack("<QQI4xQQ", 0, root, 1, tree, heap)
    return bytes(image.data)


def packed(name: str, dims: tuple[int, ...]) -> Callable:
    """The cells of one chunk, ``a, b, c`` by dimension, to its bytes."""
    chunk, kind, fill = chunk_shape(name, dims), np.dtype(FIELDS[name][3]), FILLS.get(FIELDS[name][1], 0)

    def pack(cells: pd.DataFrame) -> pd.DataFrame:
        out = np.full(chunk, fill, kind)
        at = [cells[c].to_numpy() for c in "abc"[: len(chunk)]]
        out[tuple(x % k for x, k in zip(at, chunk, strict=True))] = cells["value"].to_numpy().astype(kind)
        offsets = [int(x[0]) // k * k for x, k in zip(at, chunk, strict=True)] + [0, 0]
        return pd.DataFrame([(name, *offsets[:3], encode(out))], columns=["field", "a", "b", "c", "data"])

    return pack


def write_hdf5(tables: dict[str, DataFrame], path: str, overwrite: bool = False) -> None:
    """Write a run's tables as one file. Chunks are filled and compressed by tasks; the driver lays out the descriptions from their sizes and copies chunk after chunk, one in memory at a time, as one file is one stream. Names and lengths of references have no place in it."""
    spark = tables["run"].sparkSession
    if is_taken(spark, path) and not overwrite:
        raise FileExistsError(f"{path} is not empty; pass overwrite to replace it")
    run = tables["run"].first().asDict()
    n, cap = run["n_refs"], run["cap"]
    shapes, values, parts = {}, {}, []
    for name, (table, column, _, dtype) in FIELDS.items():
        if table not in tables or column not in tables[table].columns:
            continue
        dims = shapes[name] = shape(name, n, cap)
        if not dims:
            values[name] = run[column]
            continue
        keys = {"profile": ["tid", "pos"], "lengths": ["tid", F.col("length") - 1], "ref_stats": ["tid"], "pairs": ["tid", "i", "j"]}[table]
        named = [(F.col(k) if isinstance(k, str) else k).cast("long").alias(c) for k, c in zip(keys, "abc", strict=False)]
        cells = tables[table].select(*named, *(F.lit(0).cast("long").alias(c) for c in "abc"[len(keys) :]), F.col(column).cast("double" if dtype == "<f4" else "long").alias("value"))
        places = [F.floor(F.col(c) / k).alias(f"chunk_{c}") for c, k in zip("abc", chunk_shape(name, dims), strict=False)]
        parts.append(cells.groupBy(*places).applyInPandas(packed(name, dims), "field string, a long, b long, c long, data binary"))
    blobs = materialize(reduce(DataFrame.unionByName, parts), "hdf5-chunks")
    ordered = blobs.withColumn("rank", F.array_position(F.array(*map(F.lit, FIELDS)), F.col("field"))).orderBy("rank", "a", "b", "c")
    chunks = {name: [] for name in shapes}
    for r in ordered.select("field", "a", "b", "c", F.length("data").alias("size")).collect():  # a row a chunk
        chunks[r["field"]].append(((r["a"], r["b"], r["c"])[: len(shapes[r["field"]])], r["size"]))
    attributes = {k: run[k] or "" for k in ("program", "version")}
    base = len(described(shapes, chunks, values, attributes, 0))
    fs, final = fs_path(spark, path)
    beside = fs_path(spark, path + "._writing")[1]
    out = fs.create(beside, True)
    try:
        out.write(bytearray(described(shapes, chunks, values, attributes, base)))
        for r in ordered.select("data").toLocalIterator():
            out.write(r["data"])
    finally:
        out.close()
    fs.delete(final, True)
    if not fs.rename(beside, final):
        raise OSError(f"{path}._writing could not be moved to {path}")
