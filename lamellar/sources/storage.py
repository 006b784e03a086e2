"""Where tables are read from and where intermediate results are kept."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data directory; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``, or our own where it is unset in local mode.

    Our own folder is machine-local; on a cluster, executors wouldn't see each other's files there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='lamellar-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; it goes when the application ends."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def drop(df: DataFrame) -> None:
    """Delete what ``materialise`` wrote for ``df``, once nothing reads it any more; other tables stay."""
    path = getattr(df, "_kept_at", None)
    if path:
        spark = df.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text, hidden files included, from any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{fresh_dir(spark, label)}/data"
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._kept_at = path
    return kept


def bucketed(df: DataFrame, keys: list[str], buckets: int, label: str) -> DataFrame:
    """Like ``materialise``, in buckets by ``keys``: a join on all of them doesn't shuffle these rows."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}".replace("-", "_")
    path = f"{fresh_dir(spark, label)}/data"
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    kept = spark.table(name)
    kept._kept_at = path
    return kept
