"""Improvements and kept checkpoints as state that any order of arrival brings to the same end.

A step that arrives late may come before values that were reported as improvements, or be better than a
checkpoint that is kept. So what is written is a log of changes, each with the number it has in its group; the last
change of a step says whether it counts. State is the improvements themselves, or the checkpoints that are kept: no more.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

IMPROVED = "run string, mode string, step long, value double, counts boolean, nth long"
KEPT = "run string, step long, val_loss double, counts boolean, nth long"
_STATE = "steps array<long>, held array<double>, nth long"


def climb(steps: list[int], held: list[float], step: int, value: float) -> list[tuple[int, float, bool]]:
    """Takes one value into the improvements, which rise with the steps; what came and what went.

    An improvement is above 0 and above all values of earlier steps; of one step's values the highest counts.
    """
    at = bisect.bisect_left(steps, step)
    again = at < len(steps) and steps[at] == step
    before = held[at] if again else held[at - 1] if at else 0.0
    if not value > before:
        return []
    changes = [(step, value, True)]
    upto = at + again
    while upto < len(steps) and held[upto] <= value:
        changes.append((steps[upto], held[upto], False))
        upto += 1
    steps[at:upto], held[at:upto] = [step], [value]
    return changes


def keep(steps: list[int], held: list[float], step: int, loss: float, most: int) -> list[tuple[int, float, bool]]:
    """Takes one checkpoint into the ``most`` of least loss, ties by step; what came and what went. A step counts once, with its least loss."""
    changes = []
    if step in steps:
        old = steps.index(step)
        if held[old] <= loss:
            return []
        del steps[old], held[old]
    at = bisect.bisect_left(list(zip(held, steps, strict=True)), (loss, step))
    if at >= most:
        return []
    steps.insert(at, step)
    held.insert(at, loss)
    changes.append((step, loss, True))
    if len(steps) > most:
        changes.append((steps.pop(), held.pop(), False))
    return changes


def _with_state(take, schema: str):
    """A function on groups that passes each value to ``take`` and numbers what changes; nulls and NaN are no values."""
    names = [c.split()[0] for c in schema.split(", ")]

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        steps, held, nth = (list(state.get[0]), list(state.get[1]), state.get[2]) if state.exists else ([], [], 0)
        found = []
        for frame in frames:
            rows = frame.dropna()
            for step, value in zip(rows.iloc[:, -2].tolist(), rows.iloc[:, -1].tolist(), strict=True):
                for change in take(steps, held, int(step), float(value)):
                    found.append((*key, *change, nth))
                    nth += 1
        state.update((steps, held, nth))
        if found:
            yield pd.DataFrame(found, columns=names)

    return advance


def improvement_changes(scalars: DataFrame) -> DataFrame:
    """IMPROVED: changes of the improvements by run and mode. ``scalars``: run, mode, step and value, a stream."""
    rows = scalars.select("run", "mode", F.col("step").cast("long").alias("step"), F.col("value").cast("double").alias("value"))
    take = _with_state(climb, IMPROVED)
    return rows.groupBy("run", "mode").applyInPandasWithState(take, IMPROVED, _STATE, "append", GroupStateTimeout.NoTimeout)


def checkpoint_changes(scalars: DataFrame, most: int = 100) -> DataFrame:
    """KEPT: changes of the ``most`` best checkpoints of each run. ``scalars``: run, step and val_loss, a stream."""
    rows = scalars.select("run", F.col("step").cast("long").alias("step"), F.col("val_loss").cast("double").alias("val_loss"))
    take = _with_state(lambda steps, held, step, loss: keep(steps, held, step, loss, most), KEPT)
    return rows.groupBy("run").applyInPandasWithState(take, KEPT, _STATE, "append", GroupStateTimeout.NoTimeout)


def settled(changes: DataFrame) -> DataFrame:
    """What counts by the log of changes: the last one of each step."""
    keys = [c for c in changes.columns if c in ("run", "mode", "step")]
    value = "value" if "value" in changes.columns else "val_loss"
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(value, "counts"), "nth").alias("last"))
    return last.filter("last.counts").select(*keys, f"last.{value}")


def append_changes(changes: DataFrame, out: str, checkpoint: str) -> None:
    """Take all that is there, append the changes as Parquet, and stop; a restart goes on from the checkpoint."""
    q = changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    q.outputMode("append").trigger(availableNow=True).start().awaitTermination()
