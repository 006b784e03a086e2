"""The scalar log as a stream: the best value by run and mode, kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCALARS = "run string, mode string, step long, value double"
IMPROVED = "run string, mode string, step long, best double"


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    best = state.get[0] if state.exists else 0.0
    rows = pd.concat(list(frames)).sort_values("step")
    found = []
    for step, value in zip(rows.step, rows.value, strict=True):
        if value > best:  # strictly; a missing value is never above
            best = value
            found.append((*key, step, best))
    state.update((best,))
    if found:
        yield pd.DataFrame(found, columns=["run", "mode", "step", "best"])


def improvements(scalars: DataFrame) -> DataFrame:
    """A row for every value above all before it, which are at least 0. ``scalars``: SCALARS, a stream.

    State is one number per run and mode and survives a restart through the checkpoint. Within one
    batch rows are taken by step; a step that arrives in a later batch than its successors is judged
    against what was best by then.
    """
    return scalars.groupBy("run", "mode").applyInPandasWithState(_advance, IMPROVED, "best double", "append", GroupStateTimeout.NoTimeout)


def current_best(scalars: DataFrame) -> DataFrame:
    """run, mode, best as a plain streaming aggregate, for update output."""
    from pyspark.sql import functions as F

    return scalars.groupBy("run", "mode").agg(F.greatest(F.max("value"), F.lit(0.0)).alias("best"))


def run_once(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Take all that is there, append improvements as Parquet, and stop."""
    q = improvements(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    q.outputMode("append").trigger(availableNow=True).start().awaitTermination()
