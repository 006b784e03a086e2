"""Choosing thresholds and checkpoints, and the best value so far."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamellar.functions.scalar import scaled_sigmoid


def threshold_grid(spark: SparkSession, low: int = -1, high: int = 11) -> DataFrame:
    """ord, thr: the scaled sigmoid of whole numbers, to four places."""
    rows = spark.range(low, high + 1).select((F.col("id") - low).alias("ord"), F.round(scaled_sigmoid(F.col("id")), 4).alias("thr"))
    return rows


def best_threshold(scores: DataFrame) -> DataFrame:
    """thr, nerl of the highest nerl; of equal ones the first in order. A nerl of 0 or less is never taken."""
    first = F.max_by(F.struct("thr", "nerl"), F.struct("nerl", -F.col("ord"))).alias("b")
    return scores.filter("nerl > 0").agg(first).select("b.thr", "b.nerl")


def best_without_mergers(scores: DataFrame) -> DataFrame:
    """Best values among thresholds without non-background mergers, and the least voi of all.

    1e100 and -1 stand for none, as callers expect numbers.
    """
    free = F.col("n_non0_mergers") == 0
    return scores.agg(
        F.coalesce(F.min("voi_sum"), F.lit(1e100)).alias("best_voi"),
        F.coalesce(F.min(F.when(free, F.col("voi_sum"))), F.lit(1e100)).alias("best_voi_no_merge"),
        F.coalesce(F.max(F.when(free, F.col("nerl"))), F.lit(-1.0)).alias("best_nerl_no_merge"),
    )


def running_best(scores: DataFrame) -> DataFrame:
    """Adds best and improved: by run and mode, the highest value up to each step, from 0."""
    upto = W.partitionBy("run", "mode").orderBy("step").rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy("run", "mode").orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    was = F.greatest(F.coalesce(F.max("value").over(before), F.lit(0.0)), F.lit(0.0))
    return scores.withColumns({"best": F.greatest(F.max("value").over(upto), F.lit(0.0)), "improved": F.col("value") > was})


def top_checkpoints(scores: DataFrame, keep: int = 100) -> DataFrame:
    """The ``keep`` checkpoints of least val_loss, ties by step: each task keeps its own first."""
    return scores.orderBy("val_loss", "step").limit(keep)


def first_batches(samples: DataFrame, order: str, size: int, batches: int = 100) -> DataFrame:
    """The samples of the first ``batches`` batches in order, which is all that validation looks at."""
    return samples.orderBy(order).limit(size * batches)


def dataset_length(sizes: DataFrame) -> DataFrame:
    """dataset, length: int(mult * prod(S - 2 off) / size^3), the least over members."""
    free = (F.col("sx") - 2 * F.col("off")) * (F.col("sy") - 2 * F.col("off")) * (F.col("sz") - 2 * F.col("off"))
    length = F.floor(F.col("mult") * free / F.pow(F.col("size"), 3)).cast("long")
    return sizes.groupBy("dataset").agg(F.min(length).alias("length"))


def concat_length(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.sum("length").alias("length"))
