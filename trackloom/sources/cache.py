"""Scans kept in memory until their files change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trackloom.sources.store import versions


class ScanCache:
    """Persisted scans by path. A scan is read again when a file under its path has come, gone or changed in size or time, and
    what was kept of it is let go; of more than ``most`` scans the one used longest ago goes."""

    def __init__(self, spark: SparkSession, most: int = 16):
        self.spark, self.most = spark, most
        self.held: dict[tuple, tuple[tuple, DataFrame]] = {}

    def scan(self, path: str, read: Callable[[SparkSession, str], DataFrame] | None = None) -> DataFrame:
        """The table at ``path`` by ``read`` (Parquet by default), kept; its first action fills it."""
        key, now = (path, read), versions(path)
        kept = self.held.pop(key, None)
        if kept is not None and kept[0] != now:
            kept[1].unpersist()
            self.spark.catalog.refreshByPath(path)
            kept = None
        if kept is None:
            kept = (now, (read(self.spark, path) if read else self.spark.read.parquet(path)).persist())
        self.held[key] = kept
        while len(self.held) > self.most:
            self.held.pop(next(iter(self.held)))[1].unpersist()
        return kept[1]

    def forget(self, path: str | None = None) -> None:
        """Let go of all scans, or of those of one path."""
        for key in [k for k in self.held if path is None or k[0] == path]:
            self.held.pop(key)[1].unpersist()

    def __enter__(self) -> ScanCache:
        return self

    def __exit__(self, *_) -> None:
        self.forget()
