"""Alignments as SAM text, references as FASTA and structures as dot-bracket, all through Spark's splittable text reader (plain or gzip)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..joins import spread_join
from ..scratch import materialize

NO_SEQ = "*"
#: One base of quality 9 reads like no qualities: the tag of original qualities says that the star is one.
STAR_TAG = r"(^|\t)OQ:Z:\*(\t|$)"
LONGEST_LINE = 4095
PAIRING = r"^[()\[\]{}<>.\-]+$"


#: Bases of a piece of a reference at most.
PIECE = 1 << 16

FILE, BLOCK = "_file", "_block"
_PIECE_SCHEMA = f"{FILE} string, {BLOCK} bigint, head int, name string, comment string, at bigint, n int, bases string"
_PIECE_COLUMNS = [x.split()[0] for x in _PIECE_SCHEMA.split(", ")]
_PIECE_TYPES = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string()]


def located(spark: SparkSession, path: str, **options) -> DataFrame:
    """Lines of text (``value``) with the file and the split of it that they are from."""
    return spark.read.options(**options).text(path).select("value", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(BLOCK))


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` of ``located`` lines, with each one's ordinal in the input in column ``name``, by files in order of their names: its place in its split after the sizes of those before, without a sort or a single task."""
    placed = rows.withColumn("_id", F.monotonically_increasing_id())
    splits = placed.groupBy(FILE, BLOCK).agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(FILE, BLOCK).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = splits.select(FILE, BLOCK, "_first", before.alias("_before"))  # a row a split
    return placed.join(F.broadcast(offsets), [FILE, BLOCK]).withColumn(name, F.col("_before") + F.col("_id") - F.col("_first")).drop("_id", "_first", "_before", FILE, BLOCK)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return located(spark, path).select(F.rtrim(F.replace("value", F.lit("\r"), F.lit(""))).alias("line"), FILE, BLOCK)


def header_is_sorted(spark: SparkSession, path: str) -> bool:
    """Whether the first line, of the first file by name, is ``@HD`` and says exactly ``SO:coordinate``."""
    files = sorted(spark.read.text(path).inputFiles())
    first = _lines(spark, files[0]).limit(1).collect() if files else []
    return bool(first) and first[0][0].startswith("@HD") and "SO:coordinate" in first[0][0].split("\t")


def _tag(name: str) -> Column:
    return F.nullif(F.regexp_extract("line", rf"\t{name}:([^\t]*)", 1), F.lit(""))


def read_declared(spark: SparkSession, path: str, file_id: int = 0) -> DataFrame:
    """``declared``: the references a SAM header names, by ordinal. The text is read once: its header lines are written, and numbered by their places in their splits."""
    lines = _lines(spark, path).filter(F.col("line").startswith("@SQ")).withColumn("_at", F.monotonically_increasing_id())
    head = materialize(lines, "sam-header")
    splits = head.groupBy(FILE, BLOCK).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(FILE, BLOCK).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = head.join(F.broadcast(splits.select(FILE, BLOCK, before.alias("_before"))), [FILE, BLOCK])
    tid = F.col("_before") + F.row_number().over(Window.partitionBy(FILE, BLOCK).orderBy("_at")) - 1
    return placed.select(F.lit(file_id).alias("file_id"), tid.cast("int").alias("tid"), _tag("SN").alias("name"), _tag("LN").cast("bigint").alias("len"), _tag("M5").alias("m5"))


def read_sam(spark: SparkSession, paths: list[str] | str, require_sorted: bool = False, with_numbers: bool = True) -> DataFrame:
    """``alignments`` of one or more SAM files; only the fields that are counted are parsed. The same file twice counts twice, but is read as if given once. Without ``with_numbers`` there is no ``rec_no``, which takes a pass of its own."""
    given: dict[str, list[int]] = {}
    for file_id, path in enumerate([paths] if isinstance(paths, str) else paths):
        given.setdefault(path, []).append(file_id)
    parts = None
    for path, file_ids in given.items():
        if require_sorted and not header_is_sorted(spark, path):
            raise ValueError(f"{path}: not sorted by coordinate")
        field = F.split("line", "\t", 12)
        rows = _lines(spark, path).filter(~F.col("line").startswith("@") & (F.col("line") != ""))
        rows = numbered(rows, "rec_no") if with_numbers else rows
        number = ["rec_no"] if with_numbers else []
        names = read_declared(spark, path).select(F.col("name").alias("rname"), F.col("tid").alias("ref_tid"))
        value = lambda i: F.nullif(field[i], F.lit(NO_SEQ))
        qual = F.when((field[10] == NO_SEQ) & (F.length(value(9)) == 1) & F.get(field, F.lit(11)).rlike(STAR_TAG), NO_SEQ).otherwise(value(10))
        read = rows.select(*number, field[1].cast("int").alias("flag"), field[2].alias("rname"), (field[3].cast("bigint") - 1).alias("pos"), field[4].cast("smallint").alias("mapq"), field[5].alias("cigar"), value(9).alias("seq"), qual.alias("qual"))
        of_file = F.lit(file_ids[0]) if len(file_ids) == 1 else F.explode(F.array(*map(F.lit, file_ids)))
        found = read.join(names, "rname", "left").select(
            of_file.alias("file_id"), *number, F.coalesce("ref_tid", F.lit(-1)).alias("tid"), "pos", "flag", "mapq", "cigar", "seq", "qual", F.coalesce(F.length("seq"), F.lit(0)).alias("l_qseq")
        )
        parts = found if parts is None else parts.unionByName(found)
    return parts


def _records(spark: SparkSession, path: str) -> DataFrame:
    """Text between ``>`` at line starts, a row each."""
    rows = located(spark, path, lineSep="\n>").select(F.translate("value", "\r", "").alias("value"), FILE, BLOCK)
    return rows.filter(F.trim(F.regexp_replace("value", "\n", "")) != "")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``references``, numbered as they stand; a name ends at the first blank, the rest of its line is the comment."""
    record = F.regexp_replace("value", "^>", "")
    head, body = F.substring_index(record, "\n", 1), F.regexp_replace(record, "^[^\n]*\n?", "")
    named = numbered(_records(spark, path), "tid").select(F.col("tid").cast("int").alias("tid"), F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.nullif(F.trim(F.regexp_extract(head, r"^\S*\s(.*)$", 1)), F.lit("")).alias("comment"), F.regexp_replace(body, r"\s", "").alias("seq"))
    return named.withColumn("len", F.length("seq"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in order to pieces: ``head`` counts the names of a split, 0 is what goes on from the split before; ``at`` are the bases since. A name's first piece has it, and may be empty."""
    split, head, at, title, held, rows = None, 0, 0, None, [], []

    def cut(all_of_it: bool) -> None:
        nonlocal at, title, held
        text = "".join(held)
        ends = range(0, len(text) if all_of_it else len(text) - len(text) % PIECE, PIECE)
        for k in ends if text else ([0] if title is not None and all_of_it else []):
            bases = text[k : k + PIECE]
            name, comment = (None, None) if title is None else title
            rows.append((*split, head, name, comment, at, len(bases), bases))
            at, title = at + len(bases), None
        held = [] if all_of_it else [text[len(ends) * PIECE :]]

    def taken() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PIECE_TYPES, strict=True)], names=_PIECE_COLUMNS)
        rows.clear()
        return made

    for batch in batches:
        if not batch.num_rows:
            continue
        lines, files = batch["value"].cast(pa.large_binary()), batch[FILE].dictionary_encode()
        offsets, data = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1], memoryview(lines.buffers()[2] or b"")
        names = np.flatnonzero(pc.starts_with(lines, b">").to_numpy(zero_copy_only=False))
        place = np.stack([files.indices.to_numpy(), batch[BLOCK].to_numpy()])
        borders = np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1
        is_name = set(names.tolist())
        # What lies between names and borders of splits is one stretch of the batch's bytes: lines have no ends any more.
        stops = np.unique(np.concatenate([[0], names, names + 1, borders, [len(lines)]]))
        for k, end in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True):
            here = (files.dictionary[int(place[0, k])].as_py(), int(place[1, k]))
            if here != split:
                if split is not None:
                    cut(True)
                split, head, at, title = here, 0, 0, None
            if k in is_name:
                cut(True)
                line = bytes(data[offsets[k] + 1 : offsets[k + 1]]).decode("utf-8", "replace")
                name = re.match(r"\S*", line)[0]
                head, at, title = head + 1, 0, (name, line[len(name) :].strip() or None)
            else:
                held.append(bytes(data[offsets[k] : offsets[end]]).translate(None, b" \t\r\n\v\f").decode("utf-8", "replace"))
                if sum(map(len, held)) >= PIECE:
                    cut(False)
        if rows:
            yield taken()
    if split is not None:
        cut(True)
    if rows:
        yield taken()


def read_fasta_pieces(spark: SparkSession, path: str) -> DataFrame:
    """References as ``read_fasta`` numbers them, in pieces of up to ``PIECE`` bases (``profilewright.pieces``): lines are read, so a record may be of any length and span any number of splits. What stands before a file's first name is passed over.

    Pieces are written once; a row a split then tells each which record it goes on with, and after how many bases. A line must fit a row.
    """
    cut = materialize(located(spark, path).mapInArrow(_pieces, _PIECE_SCHEMA), "fasta-pieces")
    by_name = cut.groupBy(FILE, BLOCK, "head").agg(F.sum("n").alias("n"))
    splits = by_name.groupBy(FILE, BLOCK).agg(F.max("head").alias("heads"), F.max_by("n", "head").alias("tail"))  # a row a split
    ahead = lambda *by: Window.partitionBy(*by).orderBy(*([] if by else [FILE]), BLOCK)
    summed = splits.withColumn("upto", F.sum("heads").over(ahead())).withColumn("run", F.sum("tail").over(ahead(FILE, "upto")))
    place = summed.select(
        FILE, BLOCK, (F.col("upto") - F.col("heads")).alias("before"), F.coalesce(F.lag("run").over(ahead(FILE)), F.lit(0)).alias("carried"),
        (F.sum("heads").over(ahead(FILE)) - F.col("heads")).alias("of_file"),
    )
    found = cut.join(F.broadcast(place), [FILE, BLOCK]).filter((F.col("head") > 0) | (F.col("of_file") > 0)).select(
        (F.col("before") + F.col("head") - 1).cast("int").alias("tid"), "name", "comment", (F.col("at") + F.when(F.col("head") == 0, F.col("carried")).otherwise(0)).alias("from_base"), "n", "bases",
    )
    # Names and comments are with a record's first piece alone.
    records = found.groupBy("tid").agg(F.max("name").alias("name"), F.max("comment").alias("comment"), F.sum("n").cast("int").alias("len"), F.count(F.lit(1)).alias("rows_of_key"))
    records = materialize(records, "fasta-records")
    full = found.drop("name", "comment")
    joined = spread_join(full, records.drop("rows_of_key"), ["tid"], "fasta", records.select("tid", "rows_of_key"))
    return joined.filter((F.col("n") > 0) | (F.col("len") == 0)).select("tid", "name", "comment", "len", "from_base", "bases")


def read_structures(spark: SparkSession, path: str) -> DataFrame:
    """``structures``: the pairing under each name; other lines, as the sequence, are passed over. Two pairings under a name, one before any name, or a line of 4096 characters or more are refused when the rows are read."""
    lines = F.transform(F.split(F.regexp_replace("value", "^>", ""), "\n"), lambda x: F.trim(x))
    split = _records(spark, path).select(F.col("value").startswith(">").alias("marked"), lines.alias("lines"))
    body = split.select(
        F.regexp_extract(F.ltrim(F.get("lines", F.lit(0))), r"^([^ \t]*)", 1).alias("name"),
        F.filter(F.slice("lines", 2, F.greatest(F.lit(1), F.size("lines"))), lambda x: x.rlike(PAIRING)).alias("pairings"),
        F.exists("lines", lambda x: F.length(x) > LONGEST_LINE).alias("long"),
        F.get("lines", F.lit(0)).rlike(PAIRING).alias("headless"),
    )
    problem = F.when(F.col("long"), "a line is too long").when(F.size("pairings") > 1, "two pairings under a name").when(F.col("headless") & (F.size("pairings") == 0), "a pairing before any name")
    ok = F.when(problem.isNotNull(), F.raise_error(problem).cast("boolean")).otherwise(F.size("pairings") == 1)
    return body.filter(ok).select("name", F.get("pairings", F.lit(0)).alias("pairing"))


def sam_lines(alignments: DataFrame, references: DataFrame) -> DataFrame:
    """One column of SAM text, header first, records by reference and position; a range sort, not one task."""
    from ..functions.scalars import sequence_md5

    head = references.select(F.concat_ws("\t", F.lit("@SQ"), F.concat(F.lit("SN:"), F.col("name")), F.concat(F.lit("LN:"), F.col("len").cast("string")), F.concat(F.lit("M5:"), sequence_md5(F.col("seq")))).alias("value"), F.lit(-1).alias("a"), F.col("tid").cast("bigint").alias("b"))
    hd = references.sparkSession.range(1).select(F.lit("@HD\tVN:1.6\tSO:coordinate").alias("value"), F.lit(-2).alias("a"), F.lit(0).cast("bigint").alias("b"))
    star = lambda c: F.coalesce(F.col(c), F.lit("*"))
    named = alignments.join(references.select("tid", "name"), "tid", "left")
    mapped = F.col("flag").bitwiseAND(4) == 0
    body = named.select(
        F.concat_ws("\t", F.concat(F.lit("r"), F.col("rec_no").cast("string")), F.col("flag").cast("string"), star("name"), (F.col("pos") + 1).cast("string"), F.col("mapq").cast("string"), star("cigar"), F.lit("*"), F.lit("0"), F.lit("0"), star("seq"), star("qual"), F.when(F.col("qual") == NO_SEQ, "OQ:Z:*")).alias("value"),
        F.when(mapped, F.col("tid")).otherwise(2147483647).alias("a"), F.col("pos").alias("b"),
    )
    return hd.unionByName(head).unionByName(body).orderBy("a", "b").select("value")


def fasta_lines(references: DataFrame, width: int = 60) -> DataFrame:
    """One column of FASTA text, wrapped, with the comments after the names."""
    return references.orderBy("tid").select(F.concat(F.lit(">"), F.concat_ws(" ", "name", "comment"), F.lit("\n"), F.rtrim(F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n"))).alias("value"))
