"""References in pieces, ``tid, name, comment, len, from_base, bases``, so that no row holds a long one; a table with ``seq`` holds them whole.

A piece has ``from_base`` bases of its reference before it. A reference without bases has one empty piece, any other none that is empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.scalars import sequence_md5


def is_cut(references: DataFrame) -> bool:
    return "bases" in references.columns


def heads(references: DataFrame) -> DataFrame:
    """``tid, name, comment, len``: a row a reference, without its bases."""
    first = references.filter("from_base = 0") if is_cut(references) else references
    return first.select("tid", "name", *(["comment"] if "comment" in references.columns else []), "len")


def letters(references: DataFrame) -> DataFrame:
    """``tid, pos, letter``: a row a base. A row's letters are parted in one pass."""
    held, start = ("bases", F.col("from_base")) if is_cut(references) else ("seq", F.lit(0))
    each = references.select("tid", start.alias("start"), F.length(held).alias("n"), F.posexplode(F.split(held, "")).alias("k", "letter"))
    return each.filter("k < n").select("tid", (F.col("start") + F.col("k")).cast("int").alias("pos"), "letter")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tid, digest = None, None
    done = lambda: pa.RecordBatch.from_pydict({"tid": pa.array([tid], pa.int32()), "m5": [digest.hexdigest()]})
    for batch in batches:
        for own, bases in zip(batch["tid"].to_pylist(), batch["bases"].to_pylist(), strict=True):
            if own != tid:
                if digest is not None:
                    yield done()
                tid, digest = own, hashlib.md5(usedforsecurity=False)
            digest.update(bases.encode())
    if digest is not None:
        yield done()


def checksums(references: DataFrame) -> DataFrame:
    """``tid, m5`` of the bases in upper case.

    A digest takes a reference's pieces one after the other, so they go to one task in order; it holds one batch of them at a time.
    """
    if not is_cut(references):
        return references.select("tid", sequence_md5(F.col("seq")).alias("m5"))
    ordered = references.select("tid", "from_base", F.upper("bases").alias("bases")).repartition("tid").sortWithinPartitions("tid", "from_base")
    return ordered.select("tid", "bases").mapInArrow(_digests, "tid int, m5 string")
