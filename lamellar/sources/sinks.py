"""Results that are written: segmentations, chosen thresholds, scalar logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lamellar.operators.quality import Check


def write_volume(df: DataFrame, path: str, overwrite: bool, block: int | None = 512) -> None:
    """A voxel table, clustered by block so that boxes prune files. Without ``overwrite`` a table there is an error."""
    if block:
        df = df.withColumns({f"b{a}": F.floor(F.col(a) / block).cast("int") for a in ("x", "y", "z")})
        df = df.repartition("bx", "by", "bz").sortWithinPartitions("bx", "by", "bz", "x", "y", "z")
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def write_best_threshold(best: DataFrame, path: str) -> None:
    """One line of text with the chosen threshold."""
    best.select(F.col("thr").cast("string").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def append_scalars(scalars: DataFrame, path: str) -> None:
    """Adds rows (run, tag, value, step) to a log; only numbers are kept."""
    scalars.filter("value is not null").select("run", "tag", F.col("step").cast("long"), F.col("value").cast("double")).write.mode("append").parquet(path)


def append_text(rows: DataFrame, path: str) -> None:
    """Adds rows (run, tag, step, text) to a log of text; rows without a text are left out."""
    rows.filter("text is not null").select("run", "tag", F.col("step").cast("long").alias("step"), "text").write.mode("append").parquet(path)


def append_images(rows: DataFrame, path: str) -> None:
    """Adds pixels (tag, step, i, j, c, value) to a log of images, values between 0 and 1 as they are shown."""
    shown = F.least(F.greatest(F.col("value").cast("double"), F.lit(0.0)), F.lit(1.0))
    rows.select("tag", F.col("step").cast("long").alias("step"), "i", "j", "c", shown.alias("value")).write.mode("append").partitionBy("tag").parquet(path)


def write_checked(df: DataFrame, path: str, checks: Sequence[Check], overwrite: bool = False) -> None:
    """Writes Parquet if all checks hold, else raises a ValueError and leaves nothing; what was there stays.

    The checks are metrics of the write itself, so rows are computed once. They are written beside ``path`` and
    take its place at the end. Without ``overwrite`` a table there is an error.
    """
    spark = df.sparkSession
    paths = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    at, staged = paths(path), paths(f"{path.rstrip('/')}.unchecked")
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not overwrite and store.exists(at):
        raise FileExistsError(path)
    seen = Observation()
    try:
        watched = df.observe(seen, *(ok.alias(f"c{i}") for i, (_, ok) in enumerate(checks)))
        watched.write.mode("overwrite").parquet(staged.toString())
        wrong = [what for i, (what, _) in enumerate(checks) if not seen.get[f"c{i}"]]
        if wrong:
            raise ValueError("; ".join(wrong))
        if overwrite:
            store.delete(at, True)
        if not store.rename(staged, at):
            raise OSError(f"{staged.toString()} can't be renamed")
    finally:
        store.delete(staged, True)
