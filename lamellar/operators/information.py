"""Variation of information and Rand scores of paired labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contingency(labels: DataFrame, truth: str = "skel", pred: str = "seg") -> DataFrame:
    """t, p, n over the pairs whose truth isn't 0."""
    rows = labels.select(F.col(truth).alias("t"), F.col(pred).alias("p")).filter("t <> 0")
    return rows.groupBy("t", "p").agg(F.count("*").alias("n"))


def _marginals(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(table.groupBy(k).agg(F.sum("n").alias("m")) for k in ("t", "p"))


def _n_log_n(df: DataFrame, n: str, name: str) -> DataFrame:
    return df.agg(F.sum(F.col(n) * F.log2(F.col(n))).alias(f"h{name}"), F.sum(n).alias(f"n{name}"))


def voi(labels: DataFrame, truth: str = "skel", pred: str = "seg") -> DataFrame:
    """voi_split, H(pred | truth), voi_merge, H(truth | pred), and their sum, in bits."""
    table = contingency(labels, truth, pred)
    t, p = _marginals(table)
    one = _n_log_n(table, "n", "j").join(F.broadcast(_n_log_n(t, "m", "t"))).join(F.broadcast(_n_log_n(p, "m", "p")))
    split, merge = F.try_divide(F.col("ht") - F.col("hj"), "nj"), F.try_divide(F.col("hp") - F.col("hj"), "nj")
    return one.select(split.alias("voi_split"), merge.alias("voi_merge"), (split + merge).alias("voi_sum"))


def rand_scores(labels: DataFrame, truth: str = "skel", pred: str = "seg") -> DataFrame:
    """rand_split and rand_merge: squared joint counts over squared marginals."""
    table = contingency(labels, truth, pred)
    t, p = _marginals(table)
    square = lambda df, n, name: df.agg(F.sum(F.col(n).cast("double") * F.col(n)).alias(name))
    one = square(table, "n", "j").join(F.broadcast(square(t, "m", "a"))).join(F.broadcast(square(p, "m", "b")))
    return one.select(F.try_divide("j", "a").alias("rand_split"), F.try_divide("j", "b").alias("rand_merge"))
