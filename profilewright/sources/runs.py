"""A run's tables in a folder, or in one HDF5 file where the path says so: written only after the inputs are validated, the run table last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema

TABLES = {"profile": schema.PROFILE, "ref_stats": schema.REF_STATS, "lengths": schema.LENGTHS, "pairs": schema.PAIRS, "run": schema.RUN}
NEEDED = ("profile", "run")
#: Ends of paths that are HDF5 files.
ONE_FILE = (".h5", ".hdf5")
#: Positions a side of the squares in which pairs lie in a folder, and bytes of a row group, which has a few of them.
SQUARE, ROW_GROUP = 256, 1 << 22


def fs_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def is_taken(spark: SparkSession, path: str) -> bool:
    """Whether something other than an empty file or folder is there."""
    fs, p = fs_path(spark, path)
    return fs.exists(p) and (len(fs.listStatus(p)) > 0 if fs.getFileStatus(p).isDirectory() else fs.getFileStatus(p).getLen() > 0)


def by_squares(pairs: DataFrame) -> DataFrame:
    """Pairs in order of their squares of positions, each in one stretch of one task, so that a window's lie in few row groups and pages."""
    square = (F.floor(F.col(c) / SQUARE) for c in ("i", "j"))
    ranged = pairs.withColumns(dict(zip(("row_of_squares", "column_of_squares"), square, strict=True)))
    keys = ["tid", "row_of_squares", "column_of_squares"]
    return ranged.repartitionByRange(*keys).sortWithinPartitions(*keys, "i", "j").drop(*keys[1:])


def write_run(tables: dict[str, DataFrame], path: str, overwrite: bool = False) -> None:
    """Write into a folder beside ``path`` and move it there when all is done, so a failing run leaves what was there intact."""
    if unknown := set(tables) - set(TABLES):
        raise ValueError(f"unknown tables: {sorted(unknown)}")
    if missing := set(NEEDED) - set(tables):
        raise ValueError(f"a run needs {sorted(missing)}")
    if path.endswith(ONE_FILE):
        from .hdf5 import write_hdf5

        return write_hdf5(tables, path, overwrite)
    spark = tables["run"].sparkSession
    if is_taken(spark, path) and not overwrite:
        raise FileExistsError(f"{path} is not empty; pass overwrite to replace it")
    beside = path.rstrip("/") + "._writing"
    for name in sorted(tables, key=lambda n: n == "run"):
        kept = [c.split()[0] for c in TABLES[name].split(", ")]
        rows = tables[name].select(*(c for c in kept if c in tables[name].columns))
        writer = by_squares(rows).write.option("parquet.block.size", ROW_GROUP) if name == "pairs" else rows.write
        writer.mode("overwrite").parquet(f"{beside}/{name}")
    fs, final = fs_path(spark, path)
    # What was there is moved aside, and goes only when the new run stands in its place.
    aside = fs_path(spark, path.rstrip("/") + "._replaced")[1]
    fs.delete(aside, True)
    if fs.exists(final) and not fs.rename(final, aside):
        raise OSError(f"{path} could not be moved aside")
    if not fs.rename(fs_path(spark, beside)[1], final):
        fs.rename(aside, final)
        raise OSError(f"{beside} could not be moved to {path}")
    fs.delete(aside, True)


def read_run(spark: SparkSession, path: str, step: str | None = None) -> dict[str, DataFrame]:
    """The tables of a run; with ``step``, the profile has that step's fields, and lacking a required one is refused."""
    if path.endswith(ONE_FILE):
        from .hdf5 import read_hdf5

        found = read_hdf5(spark, path)
    else:
        fs, _ = fs_path(spark, path)
        found = {name: spark.read.parquet(f"{path}/{name}") for name in TABLES if fs.exists(fs_path(spark, f"{path}/{name}")[1])}
    if missing := set(NEEDED) - set(found):
        raise ValueError(f"{path} lacks {sorted(missing)}")
    if step:
        found["profile"] = found["profile"].select("tid", "pos", *schema.fields_for(step, found["profile"]))
    return found


def read_pairs(spark: SparkSession, path: str, tid: int, first: tuple[int, int], second: tuple[int, int]) -> DataFrame:
    """A run's pairs of one reference with ``i`` in ``first`` and ``j`` in ``second``, ends excluded. Of a folder only the pages that hold such pairs are decoded."""
    if path.endswith(ONE_FILE):
        pairs = read_run(spark, path)["pairs"]
    else:
        pairs = spark.read.parquet(f"{path.rstrip('/')}/pairs")
    inside = [(F.col(c) >= ends[0]) & (F.col(c) < ends[1]) for c, ends in (("i", first), ("j", second))]
    return pairs.filter((F.col("tid") == tid) & inside[0] & inside[1])


def same_shape(first: dict[str, DataFrame], second: dict[str, DataFrame]) -> bool:
    """Whether two runs have as many references, and the same longest one."""
    a, b = (r["run"].select("n_refs", "cap").first() for r in (first, second))
    return a == b


def combined_counts(first: dict[str, DataFrame], second: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables besides the profile that both inputs have, summed."""
    from ..operators.combine import add_counts

    out = {}
    if "ref_stats" in first and "ref_stats" in second:
        names = first["ref_stats"].select("tid", "name", "len")
        out["ref_stats"] = names.join(add_counts(first["ref_stats"], second["ref_stats"], ["tid"], ["counted", "rejected"]), "tid")
    if "lengths" in first and "lengths" in second:
        out["lengths"] = add_counts(first["lengths"], second["lengths"], ["tid", "length"], ["n"])
    other = second["run"].select(F.col("unmapped").alias("more"))
    out["run"] = first["run"].crossJoin(F.broadcast(other)).withColumn("unmapped", F.col("unmapped") + F.col("more")).drop("more")  # one row each
    return out
