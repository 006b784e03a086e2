"""Summary statistics of tensors kept as rows of values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tensor_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """min, max, mean and sample deviation by key."""
    return df.groupBy(*keys).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def gradient_norm(df: DataFrame, array: str) -> DataFrame:
    """norm and largest magnitude over all elements of arrays; rows are reduced before they are added."""
    double = F.transform(array, lambda v: v.cast("double"))
    square = F.aggregate(double, F.lit(0.0), lambda s, v: s + v * v)
    largest = F.array_max(F.transform(double, F.abs))
    return df.agg(F.sqrt(F.sum(square)).alias("norm"), F.max(largest).alias("max_abs"))


def masked_bce(df: DataFrame, loss: str, target: str) -> DataFrame:
    """Mean loss where the target isn't masked (-1), and the number of such places."""
    return df.filter(F.col(target) >= 0).agg(F.avg(loss).alias("loss"), F.count("*").alias("n"))
