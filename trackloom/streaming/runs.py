"""Streams that take what is there and end: sessions by timers, tumbling bins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SESSION = "key string, start_us long, last_us long, n long, total double"
OPEN = "start_us long, last_us long, n long, total double"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Sessions(StatefulProcessor):
    """Open sessions of a key as a list state; each ends by a timer once the watermark is past its gap. Rows may come in any
    order within the watermark's delay, so one row can join two sessions."""

    def __init__(self, gap_us: int):
        self.gap_us = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", OPEN)

    def _put(self, sessions: list[tuple]) -> None:
        """Keep these, with a timer for the one that ends first."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if sessions:
            self.open.put(sessions)
            self.handle.registerTimer(min(s[1] for s in sessions) // 1000 + self.gap_us // 1000 + 1)
        else:
            self.open.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        found = [tuple(s) for s in self.open.get()] if self.open.exists() else []
        for frame in rows:
            found += [(t, t, 1, v) for t, v in zip(frame["us"].tolist(), frame["value"].tolist())]
        merged: list[list] = []
        for start, last, n, total in sorted(found):
            if merged and start - merged[-1][1] <= self.gap_us:
                own = merged[-1]
                own[1], own[2], own[3] = max(own[1], last), own[2] + n, own[3] + total
            else:
                merged.append([start, last, n, total])
        self._put([tuple(s) for s in merged])
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        past = timerValues.getCurrentWatermarkInMs() * 1000
        found = [tuple(s) for s in self.open.get()]
        ended = [s for s in found if s[1] + self.gap_us < past]
        self._put([s for s in found if s[1] + self.gap_us >= past])
        if ended:
            yield pd.DataFrame([(str(key[0]), *s) for s in ended], columns=["key", "start_us", "last_us", "n", "total"])

    def close(self) -> None:
        pass


def ended_sessions(events: DataFrame, key: str, time: str, value: str, gap_s: float, delay: str) -> DataFrame:
    """Sessions of a stream as they end: rows of a key no farther apart than ``gap_s``. ``delay`` is how late rows may be; those
    that are later are dropped, and the query's progress counts them."""
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(time).cast("timestamp").alias("ts"), F.col(value).cast("double").alias("value")).withColumn("us", F.unix_micros("ts"))
    return rows.withWatermark("ts", delay).groupBy("key").transformWithStateInPandas(Sessions(int(gap_s * 1e6)), SESSION, "append", "EventTime")


def run_sessions(events: DataFrame, at: str, key: str, time: str, value: str, gap_s: float, delay: str = "0 seconds") -> tuple[DataFrame, int]:
    """All sessions of a stream's rows so far, and how many rows came too late. ``at`` holds the checkpoint and the sessions that
    have ended; a later run with the same ``at`` goes on where this one stopped. Sessions still open, which an append stream
    never emits, are read from the state store."""
    spark, conf = events.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf)
    spark.conf.set(conf, ROCKSDB)
    try:
        query = ended_sessions(events, key, time, value, gap_s, delay).writeStream.format("parquet").option("path", f"{at}/ended").option("checkpointLocation", f"{at}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        late = sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])
        ended = spark.read.schema(SESSION).parquet(f"{at}/ended").withColumn("ended", F.lit(True))
        state = spark.read.format("statestore").option("path", f"{at}/checkpoint").option("stateVarName", "open").load()
        left = state.select(F.col("key.key").alias("key"), "list_element.*", F.lit(False).alias("ended"))
        return ended.unionByName(left), late
    finally:
        spark.conf.set(conf, before)


def run_bins(events: DataFrame, at: str, key: str, time: str, width: str) -> DataFrame:
    """``start, key, n``: rows of a stream by tumbling windows and key, the open ones too. Each trigger's changed bins are a
    table of that trigger's number, written over when it is repeated; of a bin the last one counts."""
    rows = events.select(F.col(key).cast("string").alias("key"), F.window(F.col(time).cast("timestamp"), width).alias("w"))
    counts = rows.groupBy("w", "key").count().select(F.col("w.start").alias("start"), "key", F.col("count").alias("n"))

    def keep(changed: DataFrame, trigger: int) -> None:
        changed.write.mode("overwrite").parquet(f"{at}/bins/trigger={trigger}")

    counts.writeStream.foreachBatch(keep).option("checkpointLocation", f"{at}/checkpoint").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    found = events.sparkSession.read.schema("start timestamp, key string, n long, trigger long").parquet(f"{at}/bins")
    return found.groupBy("start", "key").agg(F.max_by("n", "trigger").alias("n"))
