"""Draws that depend on values alone, epochs, weights, and checks within the pass of a write."""

import math
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lamellar.functions import draws
from lamellar.operators import quality, sampling
from lamellar.sources import sinks


@pytest.mark.parametrize("many", [1, 2, 3, 7, 10, 97, 1000, 4097])
def test_a_permutation_has_each_number_once(spark, many):
    for key in (0, 5, 2_147_483_646):
        got = [r.p for r in spark.range(many).select(draws.shuffled(F.col("id"), many, F.lit(key)).alias("p")).collect()]
        assert sorted(got) == list(range(many))
        assert many < 97 or got != sorted(got)


def test_keys_give_other_orders(spark):
    rows = spark.range(500).select(*(draws.shuffled(F.col("id"), 500, F.lit(k)).alias(f"p{k}") for k in range(3))).collect()
    for a, b in ((0, 1), (1, 2)):
        assert sum(r[a] == r[b] for r in rows) < 25


def test_a_great_many_numbers(spark):
    many = 10**17
    got = [r.p for r in spark.range(many - 300, many).select(draws.shuffled(F.col("id"), many, F.lit(3)).alias("p")).collect()]
    assert len(set(got)) == 300 and all(0 <= p < many for p in got) and max(got) - min(got) > many // 2
    with pytest.raises(ValueError, match="more than 2"):
        draws.shuffled(F.col("id"), 2**63, F.lit(1))


def plain_permutation(x, many, key):
    side = math.isqrt(many - 1) + 1
    while True:
        left, right = divmod(x, side)
        for factor in draws.FACTORS:
            v = (right * factor + key) % draws.PRIME
            left, right = right, (left + (v * v + v * factor + 1) % draws.PRIME) % side
        x = left * side + right
        if x < many:
            return x


def test_arrays_are_permuted_as_numbers_are(spark):
    for many, key in ((5, 7), (1003, 2_147_483_646), (10**15, 12)):
        rows = spark.range(max(0, many - 300), many).select("id", draws.shuffled(F.col("id"), many, F.lit(key)).alias("p")).collect()
        assert [r.p for r in rows] == [plain_permutation(r.id, many, key) for r in rows]


def test_a_permutation_is_no_expression_of_each_row_and_nulls_are_errors(spark):
    """Lambdas over a row's own arrays are interpreted: a hundred steps for each row."""
    rows = spark.range(10).select(draws.shuffled(F.col("id"), 10, F.lit(1)).alias("p"))
    assert "lambda" not in rows._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="null"):
        spark.range(3).select(draws.shuffled(F.expr("nullif(id, 1)"), 3, F.lit(1))).collect()


def drawn(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize(
    "draw",
    [
        lambda df: sampling.epochs(df, 1000, 2, 3, seed=4),
        lambda df: sampling.weighted_choice(df, [0.2, 0.5, 0.3], seed=4),
        lambda df: sampling.sample_positions(df, (150, 100, 90), 32, 8, seed=4),
        lambda df: sampling.noise(df.withColumn("raw", F.lit(1.0)), "raw", 0.5, seed=4),
        lambda df: sampling.random_slices(df, "sample", 0.3, seed=4),
        lambda df: sampling.random_shifts(df.withColumnRenamed("sample", "x"), "x", 0.3, 5, seed=4),
        lambda df: sampling.random_intensity(df.withColumn("raw", F.lit(1.0)), ["sample"], "raw", 0.1, 0.2, seed=4),
    ],
)
def test_partitions_make_no_difference(spark, draw):
    rows = spark.range(1000).select(F.col("id").alias("sample"))
    assert drawn(draw(rows.repartition(1))) == drawn(draw(rows.repartition(50)))


def test_epochs_and_workers(spark):
    rows = sampling.epochs(spark.range(1003).select(F.col("id").alias("sample")), 1003, 3, 4, seed=2).collect()
    assert len(rows) == 3 * 1003
    for epoch in range(3):
        own = [r for r in rows if r.epoch == epoch]
        assert sorted(r.sample for r in own) == list(range(1003)) == sorted(r.position for r in own)
        sizes = Counter(r.worker for r in own)
        assert sorted(sizes.values()) == [250, 251, 251, 251]
        assert all(sorted(r.nth for r in own if r.worker == w) == list(range(n)) for w, n in sizes.items())
    by_epoch = [[r.sample for r in sorted((r for r in rows if r.epoch == e), key=lambda r: r.position)] for e in range(3)]
    assert by_epoch[0] != by_epoch[1] != by_epoch[2]


def test_weights_within_a_bound(spark):
    weights = [0.05, 3.0, 0.0, 1.0, 0.95]
    n = 50_000
    got = Counter(r.source for r in sampling.weighted_choice(spark.range(n), weights, seed=1).collect())
    for k, w in enumerate(weights):
        p = w / sum(weights)
        assert abs(got[k] / n - p) <= 4 * (p * (1 - p) / n) ** 0.5
    table = draws.alias_table(weights)
    share = Counter()
    for i, (own, other) in enumerate(table):
        share[i] += own / len(table)
        share[other] += (1 - own) / len(table)
    assert all(share[k] == pytest.approx(w / sum(weights)) for k, w in enumerate(weights))
    for bad in ([], [0, 0], [1, -1]):
        with pytest.raises(ValueError, match="weights"):
            draws.alias_table(bad)


def jobs(spark, group, action):
    spark.sparkContext.setJobGroup(group, group)
    try:
        action()
    finally:
        spark.sparkContext.setJobGroup("", "")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def checks():
    return [quality.not_empty(), quality.within("id", 0, 99), quality.mean_above("id", 10)]


def test_checks_are_part_of_the_write(spark, tmp_path):
    df = spark.range(100)
    plain = jobs(spark, "plain", lambda: df.write.parquet(f"{tmp_path}/plain"))
    assert jobs(spark, "checked", lambda: sinks.write_checked(df, f"{tmp_path}/checked", checks())) == plain
    assert spark.read.parquet(f"{tmp_path}/checked").count() == 100


@pytest.mark.parametrize(("rows", "said"), [((0, 0), "no rows.*mean"), ((0, 200), "outside 0 to 99"), ((0, 5), "mean of id")])
def test_a_failed_check_leaves_nothing(spark, tmp_path, rows, said):
    with pytest.raises(ValueError, match=said):
        sinks.write_checked(spark.range(*rows), f"{tmp_path}/new", checks())
    assert os.listdir(tmp_path) == []
    sinks.write_checked(spark.range(100), f"{tmp_path}/old", checks())
    with pytest.raises(FileExistsError):
        sinks.write_checked(spark.range(50), f"{tmp_path}/old", checks())
    with pytest.raises(ValueError, match=said):
        sinks.write_checked(spark.range(*rows), f"{tmp_path}/old", checks(), overwrite=True)
    assert spark.read.parquet(f"{tmp_path}/old").count() == 100 and os.listdir(tmp_path) == ["old"]
    sinks.write_checked(spark.range(60), f"{tmp_path}/old", checks(), overwrite=True)
    assert spark.read.parquet(f"{tmp_path}/old").count() == 60
