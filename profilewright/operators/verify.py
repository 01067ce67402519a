"""References against what alignment files declare."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import pieces
from ..functions.scalars import same_digest
from ..pieces import heads


def mismatches(declared: DataFrame, references: DataFrame, names: bool = True, checksums: bool = True) -> DataFrame:
    """Declarations that disagree, with a ``reason``: no such record, its length (always checked), its name or its checksum. A missing checksum is accepted; a malformed one is not."""
    own = heads(references).select("tid", F.col("name").alias("own_name"), F.col("len").alias("own_len"))
    reason = F.when(F.col("own_len").isNull(), "missing").when(F.col("len") != F.col("own_len"), "length")
    if names:
        reason = reason.when(F.col("name") != F.col("own_name"), "name")
    if checksums:
        own = own.join(pieces.checksums(references).select("tid", F.col("m5").alias("own_m5")), "tid")
        reason = reason.when(F.col("m5").isNotNull() & ~same_digest(F.col("m5"), F.col("own_m5")), "checksum")
    return declared.join(own, "tid", "left").withColumn("reason", reason).filter(F.col("reason").isNotNull()).select("file_id", "tid", "name", "reason")


def verify(declared: DataFrame, references: DataFrame, names: bool = True, checksums: bool = True) -> None:
    """Refuse references that disagree with any declaration."""
    if bad := mismatches(declared, references, names, checksums).head(5):
        raise ValueError("references disagree with the alignments: " + ", ".join(f"{r['name']} ({r['reason']})" for r in bad))
