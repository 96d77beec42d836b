"""Recorded measurements as a stream in the order of their time, a step of the clock after the other.

``spark.readStream.format("replay")`` with options ``path`` (Parquet files), ``time`` (a column of seconds), ``step`` (seconds), and
for a paced replay ``speed`` (recorded seconds in a second) and ``started`` (epoch seconds at which the first row is due). An
offset is a number of steps, so a restart goes on with the step it stopped before.
"""

from __future__ import annotations

import math
import time as clock
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema

from trackloom.sources.store import open_fs


def _dataset(path: str):
    import pyarrow.dataset as ds

    fs, base = open_fs(path)
    return ds.dataset(base, filesystem=fs, format="parquet")


@dataclass
class Step(InputPartition):
    lo: float
    hi: float

    def __init__(self, lo: float, hi: float):
        super().__init__((lo, hi))
        self.lo, self.hi = lo, hi


class ReplayReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        import pyarrow.compute as pc

        self.path, self.time, self.step = options["path"], options.get("time", "time"), float(options.get("step", 1.0))
        self.speed, self.started = float(options.get("speed", "inf")), float(options.get("started", 0.0))
        lo, hi = math.inf, -math.inf
        for batch in _dataset(self.path).to_batches(columns=[self.time]):  # one column, some rows at a time
            ends = pc.min_max(batch.column(0))
            if ends["min"].is_valid:
                lo, hi = min(lo, ends["min"].as_py()), max(hi, ends["max"].as_py())
        self.first = math.floor(lo / self.step) if lo <= hi else 0
        self.steps = math.floor(hi / self.step) + 1 - self.first if lo <= hi else 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"step": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        """Steps that are over by now; all of them in an unpaced replay."""
        if math.isinf(self.speed):
            return {"step": self.steps}
        return {"step": max(0, min(self.steps, math.floor((clock.time() - self.started) * self.speed / self.step)))}

    def partitions(self, start: dict, end: dict) -> list[Step]:
        return [Step((self.first + k) * self.step, (self.first + k + 1) * self.step) for k in range(start["step"], end["step"])]

    def read(self, partition: Step) -> Iterator:
        import pyarrow.compute as pc

        t = pc.field(self.time)
        table = _dataset(self.path).to_table(filter=(t >= partition.lo) & (t < partition.hi)).sort_by(self.time)
        yield from table.to_batches()

    def commit(self, end: dict) -> None:
        pass


class ReplaySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "replay"

    def schema(self):
        return from_arrow_schema(_dataset(self.options["path"]).schema)

    def streamReader(self, schema) -> ReplayReader:  # noqa: N802
        return ReplayReader(self.options)
