"""The tracker as a stream: the engine that batch runs, kept in the state store by scenario."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trackloom.operators.tracking import NAMES, OUTPUT, Engine, _row, measurements


def fuse_stream(sensor: DataFrame, algorithm: str = "imm", lateness: str = "10 seconds") -> DataFrame:
    """Fused rows of a stream with columns SENSOR and a timestamp ``ts``.

    Measurements wait in state until the watermark passes their time, then run in (time, ordinal) order, so the stream
    gives what batch gives whatever the arrival order within ``lateness``; later rows are dropped by the watermark."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        engine, waiting = pickle.loads(state.get[0]) if state.exists else (Engine(algorithm), [])
        waiting = [*waiting, *frames] if not state.hasTimedOut else waiting
        until = state.getCurrentWatermarkMs() / 1000.0
        rows = []
        if waiting:
            held = pd.concat(waiting, ignore_index=True)
            seconds = held["ts"].astype("int64") / 1e9 if held["ts"].dtype.kind == "M" else held["ts"]
            ready = seconds <= until
            for time, ms in measurements(held[ready], engine.policy):
                rows += [_row(engine.policy, t, key[0]) for t in engine.step(time, ms)]
            waiting = [held[~ready]] if (~ready).any() else []
        state.update((pickle.dumps((engine, waiting)),))
        if waiting:
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, int(waiting[0]["ts"].astype("int64").min() // 1_000_000)))
        if rows:
            yield pd.DataFrame(rows, columns=NAMES)

    timed = sensor.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return timed.groupBy("scenario").applyInPandasWithState(run, OUTPUT, "engine binary", "append", GroupStateTimeout.EventTimeTimeout)


def detection_bins(events: DataFrame, time: str, key: str, width: str = "1 second", lateness: str = "10 seconds") -> DataFrame:
    """Tumbling counts by key."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness).groupBy(F.window(time, width), key).count()


def sessions(events: DataFrame, time: str, key: str, gap: str = "5 seconds", lateness: str = "10 seconds") -> DataFrame:
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness).groupBy(F.session_window(time, gap), key).count()
