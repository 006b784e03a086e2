"""State that any order of arrival, and a restart, bring to the batch's result."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lamellar.operators import selection
from lamellar.streaming import retention


def improvements(values):
    best, out = 0.0, []
    by_step = {}
    for step, v in values:
        if v == v and v is not None:
            by_step[step] = max(v, by_step.get(step, v))
    for step in sorted(by_step):
        if by_step[step] > best:
            best = by_step[step]
            out.append((step, best))
    return out


def test_climb_in_any_order():
    rng = random.Random(7)
    for _ in range(300):
        values = [(rng.randrange(12), rng.choice([-1.0, 0.0, 0.5, 1.0, 1.5, 2.0, 2.5])) for _ in range(rng.randrange(1, 25))]
        steps, held, log = [], [], {}
        for step, v in values:
            for s, x, counts in retention.climb(steps, held, step, v):
                log[s] = (x, counts)
        assert list(zip(steps, held)) == improvements(values) == sorted((s, x) for s, (x, counts) in log.items() if counts)


def test_keep_in_any_order():
    rng = random.Random(8)
    for _ in range(300):
        values = [(step, rng.choice([0.1, 0.2, 0.3, 0.4])) for step in rng.sample(range(40), rng.randrange(1, 30))]
        steps, held, log = [], [], {}
        for step, v in values:
            for s, x, counts in retention.keep(steps, held, step, v, 7):
                log[s] = (x, counts)
            assert len(steps) <= 7
        want = sorted((v, s) for s, v in values)[:7]
        assert list(zip(held, steps)) == want == sorted((x, s) for s, (x, counts) in log.items() if counts)
    steps, held = [3], [0.5]
    assert retention.keep(steps, held, 3, 0.7, 2) == [] and retention.keep(steps, held, 3, 0.2, 2) == [(3, 0.2, True)]


@pytest.mark.parametrize("order", ["forward", "backward", "mixed"])
def test_streams_end_where_the_batch_does(spark, tmp_path, order):
    rng = random.Random(3)
    rows = [(run, "val", step, rng.choice([None, float("nan"), rng.random(), rng.random()])) for run in ("a", "b") for step in range(240)]
    frame = pd.DataFrame(rows, columns=["run", "mode", "step", "value"])
    frame = {"forward": frame, "backward": frame.iloc[::-1], "mixed": frame.sample(frac=1, random_state=5)}[order]
    stream = lambda: spark.readStream.schema("run string, mode string, step long, value double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for part in range(4):  # each part after a restart from the checkpoint
        some = frame.iloc[part * 120 : (part + 1) * 120]
        spark.createDataFrame(list(some.itertuples(index=False, name=None)), "run string, mode string, step long, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if part % 2:
            retention.append_changes(retention.improvement_changes(stream()), f"{tmp_path}/improved", f"{tmp_path}/c1")
            losses = stream().select("run", "step", F.col("value").alias("val_loss"))
            retention.append_changes(retention.checkpoint_changes(losses, 20), f"{tmp_path}/kept", f"{tmp_path}/c2")
    batch = spark.read.parquet(f"{tmp_path}/in")
    want = selection.running_best(batch.filter("value is not null and not isnan(value)")).filter("improved").select("run", "mode", "step", "value")
    got = retention.settled(spark.read.parquet(f"{tmp_path}/improved"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    kept = retention.settled(spark.read.parquet(f"{tmp_path}/kept"))
    for run in ("a", "b"):
        own = batch.filter((F.col("run") == run) & F.col("value").isNotNull() & ~F.isnan("value")).select("step", F.col("value").alias("val_loss"))
        best = selection.top_checkpoints(own, 20)
        assert sorted(map(tuple, kept.filter(F.col("run") == run).drop("run").collect())) == sorted(map(tuple, best.collect()))
