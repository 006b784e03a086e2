"""Volumes, skeletons and logs derived from the driver tables, for queries and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamellar.sources.storage import materialise, read_table


def skeleton_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """skel, n, node, px, py, pz, seg: one node per order line, in order within a customer's skeleton."""
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    # By the skeleton's own column, so that windows along it need no other shuffle.
    order = W.partitionBy("skel").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey).withColumn("skel", F.col("o_custkey") + 1)
    rows = rows.withColumn("n", F.row_number().over(order).cast("long") - 1)
    seg = F.expr(
        "case when l_partkey % 23 = 0 then 0 when l_partkey % 19 = 0 then 1000000 + skel div 2 "
        "when skel % 11 = 0 then (skel - 1) * 10 + n div 25 else skel * 10 + n div 25 end"
    )
    return rows.select(
        "skel",
        "n",
        (F.col("skel") * 1000 + F.col("n")).alias("node"),
        (9 * F.col("l_quantity")).alias("px"),
        (9.0 * F.col("l_linenumber")).alias("py"),
        (20.0 * (F.col("l_partkey") % 50)).alias("pz"),
        seg.cast("long").alias("seg"),
    )


def skeleton_edges(nodes: DataFrame) -> DataFrame:
    """skel, u, v, gu, gv, su, sv, len: edges of consecutive nodes, with both ends' labels.

    A window along each skeleton gives both ends at once, in place of two joins with the nodes.
    """
    along = W.partitionBy("skel").orderBy("n")
    at = lambda c: F.lead(c).over(along)
    length = F.sqrt(sum((F.pow(F.col(c) - at(c), 2) for c in ("px", "py", "pz")), F.lit(0.0)))
    rows = nodes.select("skel", F.col("node").alias("u"), at("node").alias("v"), F.col("seg").alias("gu"), at("seg").alias("gv"), length.alias("len"))
    return rows.filter("v is not null")


def skeleton_graph(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """skel and node of all nodes, and u, v of the edges, from one kept table: whole skeletons lie together in it."""
    along = W.partitionBy("skel").orderBy("n")
    rows = materialise(nodes.select("skel", "node", F.lead("node").over(along).alias("next")), "skeletons")
    return rows.select("skel", "node"), rows.filter("next is not null").select(F.col("node").alias("u"), F.col("next").alias("v"))


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x, y, z, a0, a1, a2 (float), seg, raw: one voxel per order, a volume of 10 by 10 columns."""
    rows = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    rows = rows.selectExpr("o_orderkey as k", "o_custkey as c", "cast(round(o_totalprice * 100) as bigint) as ct")
    rows = rows.selectExpr("k", "c", "ct", "k div 100 as x", "(k div 10) % 10 as y", "k % 10 as z")
    seg = "case when c % 7 = 0 then 0 when c % 31 = 0 then -1 else 1 + (x div 5) * 4 + (y div 5) * 2 + (z div 5) end"
    return rows.selectExpr(
        "x",
        "y",
        "z",
        "cast((ct % 1000) / 1000D as float) as a0",
        "cast(((c * 7919 + k * 104729) % 1000) / 1000D as float) as a1",
        "cast(((k * 7907 + ct * 31) % 1000) / 1000D as float) as a2",
        f"cast({seg} as bigint) as seg",
        "cast(ct % 256 as double) as raw",
    )


#: The same fixtures in DuckDB.
NODES_SQL = """
nodes0 as (select o_custkey + 1 as skel, row_number() over (partition by o_custkey
  order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 as n, * from lineitem join orders on l_orderkey = o_orderkey),
nodes as (select skel, n, skel * 1000 + n as node, 9 * l_quantity as px, 9.0::double * l_linenumber as py, 20.0::double * (l_partkey % 50) as pz,
  cast(case when l_partkey % 23 = 0 then 0 when l_partkey % 19 = 0 then 1000000 + skel // 2
  when skel % 11 = 0 then (skel - 1) * 10 + n // 25 else skel * 10 + n // 25 end as bigint) as seg from nodes0),
edges as (select a.skel, a.node as u, b.node as v, a.seg as gu, b.seg as gv,
  sqrt(power(a.px - b.px, 2) + power(a.py - b.py, 2) + power(a.pz - b.pz, 2)) as len
  from nodes a join nodes b on a.skel = b.skel and b.n = a.n + 1)"""

VOXELS_SQL = """
vox0 as (select o_orderkey as k, o_custkey as c, cast(round(o_totalprice * 100) as bigint) as ct,
  o_orderkey // 100 as x, (o_orderkey // 10) % 10 as y, o_orderkey % 10 as z from orders),
vox as (select x, y, z, cast((ct % 1000) / 1000::double as float) as a0, cast(((c * 7919 + k * 104729) % 1000) / 1000::double as float) as a1,
  cast(((k * 7907 + ct * 31) % 1000) / 1000::double as float) as a2,
  cast(case when c % 7 = 0 then 0 when c % 31 = 0 then -1 else 1 + (x // 5) * 4 + (y // 5) * 2 + (z // 5) end as bigint) as seg,
  cast(ct % 256 as double) as raw from vox0)"""
