"""Skeleton graphs from node and edge tables, in any format that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "node long, skel long, x long, y long, z long, px double, py double, pz double"


def read_graph(spark: SparkSession, nodes: str, edges: str, format: str = "parquet", **options) -> tuple[DataFrame, DataFrame]:
    """Nodes (NODES; other columns stay) and edges (u, v), typed; a missing column is an error."""
    read = lambda path: spark.read.format(format).options(**options).load(path)
    rows = read(nodes)
    typed = {n: F.col(n).cast(t) for n, t in (c.split() for c in NODES.split(", "))}
    return rows.withColumns(typed), read(edges).select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))


def labelled_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """skel, u, v, gu, gv, len: an edge with the skeleton of its first end, both ends' labels ``seg`` and its length.

    An edge whose end isn't a node is left out, as is one with a null end; repeated edges each count.
    """
    end = lambda key, p: nodes.select(F.col("node").alias(key), F.col("seg").alias(f"g{key}"), *(F.col(c).alias(f"{p}{c}") for c in ("px", "py", "pz")))
    first = end("u", "a").join(nodes.select(F.col("node").alias("u"), "skel"), "u")
    rows = edges.join(first, "u").join(end("v", "b"), "v")
    length = F.sqrt(sum((F.pow(F.col(f"a{c}") - F.col(f"b{c}"), 2) for c in ("px", "py", "pz")), F.lit(0.0)))
    return rows.select("skel", "u", "v", "gu", "gv", length.alias("len"))
