"""Tables, their fields, and what each step reads and makes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALIGNMENTS = (
    "file_id int, rec_no bigint, tid int, pos bigint, flag int, mapq smallint, cigar string, seq string, qual string, l_qseq int"
)
REFERENCES = "tid int, name string, comment string, seq string, len int"
DECLARED = "file_id int, tid int, name string, len bigint, m5 string"
PROFILE = "tid int, pos int, base tinyint, coverage float, reactivity float, error float"
REF_STATS = "tid int, name string, len int, counted bigint, rejected bigint"
LENGTHS = "tid int, length int, n bigint"
PAIRS = "tid int, i int, j int, correlation float, conditional float, coverage float"
RUN = "program string, version string, n_refs int, cap int, unmapped bigint, norm float"
STRUCTURES = "name string, pairing string"

#: What a field holds where nothing was written.
FILLS = {"coverage": 0.0, "reactivity": float("nan"), "error": float("nan"), "base": -1, "length": 0, "counted": 0, "rejected": 0, "unmapped": 0, "norm": float("nan"), "correlation": float("nan"), "conditional": float("nan")}

REQUIRED, IF_PRESENT, MADE = "required", "if present", "made"
#: Fields of the profile table by step; tables besides the profile are carried if all inputs have them.
MANIFESTS = {
    "sub": {"coverage": REQUIRED, "reactivity": REQUIRED, "error": IF_PRESENT, "base": IF_PRESENT},
    "div": {"coverage": REQUIRED, "reactivity": REQUIRED, "error": REQUIRED, "base": IF_PRESENT},
    "norm": {"coverage": REQUIRED, "reactivity": REQUIRED, "error": IF_PRESENT, "base": IF_PRESENT, "norm": MADE},
    "score": {"coverage": REQUIRED, "reactivity": REQUIRED},
}


def nan(kind: str = "double") -> Column:
    """"Not measured"; null is left to mean that a row is absent."""
    return F.lit("NaN").cast(kind)


def is_finite(x: Column) -> Column:
    """Spark orders NaN above all numbers and finds it equal to itself: test it by name."""
    return ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def fields_for(step: str, *inputs) -> list[str]:
    """Fields a step carries: the required ones, and the optional ones that every input has. A required one that is missing is refused."""
    out = []
    for field, need in MANIFESTS[step].items():
        has = [field in df.columns for df in inputs]
        if need == REQUIRED and not all(has):
            raise ValueError(f"{step}: an input lacks {field}")
        if need != MADE and all(has):
            out.append(field)
    return out
