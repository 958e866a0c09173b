"""Streaming forms of the map merge and of pose integration.

The merge is a maximum: a streaming aggregation keeps one row of state per cell, and a sink
merges each micro-batch into a table.  Poses depend on the order of steps; they are folded per
environment with state.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = "x double, y double, heading double, steps long"
POSE = "env long, step long, x double, y double, heading_deg double"


def live_map(cells: DataFrame) -> DataFrame:
    """The map of all patches so far, as a streaming aggregation (update or complete mode)."""
    return cells.groupBy("env", "channel", "row", "col").agg(F.max("value").alias("value"))


def max_merge_sink(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: writes each batch, merged in itself, as path/batch=<id>.

    A repeated batch replaces its own folder, so nothing counts twice; read_map merges the batches.
    """

    def sink(batch: DataFrame, number: int) -> None:
        live_map(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sink


def read_map(spark, path: str) -> DataFrame:
    return live_map(spark.read.parquet(path))


def fold_poses(start: tuple[float, float, float], steps: list[tuple[int, float, float, float]]) -> list[tuple[int, float, float, float]]:
    """(step, x, y, heading in degrees) after each (step, dx, dy, turn in degrees); a step is turned
    by the heading before it."""
    x, y, h = start
    out = []
    for step, dx, dy, turn in steps:
        a = math.radians(h)
        x += dx * math.cos(a) - dy * math.sin(a)
        y += dx * math.sin(a) + dy * math.cos(a)
        h = (h + turn) % 360
        h = h - 360 if h > 180 else h
        out.append((step, x, y, h))
    return out


def _advance(key, frames: Iterator, state):
    import pandas as pd

    x, y, h, n = state.get if state.exists else (0.0, 0.0, 0.0, 0)
    rows = pd.concat(list(frames)).sort_values("step")
    done = fold_poses((x, y, h), list(rows[["step", "dx", "dy", "turn"]].itertuples(index=False, name=None)))
    if done:
        _, x, y, h = done[-1]
    state.update((float(x), float(y), float(h), n + len(done)))
    yield pd.DataFrame([(key[0], *d) for d in done], columns=["env", "step", "x", "y", "heading_deg"])


def pose_stream(steps: DataFrame) -> DataFrame:
    """Poses after each step of a stream (env, step, dx, dy, turn); steps of an environment arrive
    in order from batch to batch."""
    return steps.groupBy("env").applyInPandasWithState(_advance, POSE, STATE, "append", "NoTimeout")
