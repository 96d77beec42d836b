"""Registered streams: they take all that a table has, and end. Batch SQL gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.plans.queries import query
from trackloom.sources.store import shared_folder
from trackloom.streaming import runs


def stream(spark, sf: str, table: str):
    """A table as a file stream; a pattern, as a table may be one file or a folder of files."""
    schema = spark.read.parquet(f"{sf}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{table}[.]parquet")


@query("WITH e AS (SELECT user_id, epoch_us(ts) AS us, value FROM events), m AS (SELECT *, sum(CASE WHEN us - lag_us > 43200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, lag(us) OVER (PARTITION BY user_id ORDER BY us) AS lag_us FROM e)) SELECT CAST(user_id AS VARCHAR) AS user, min(us) AS start_us, max(us) AS last_us, count(*) AS n, round(sum(value), 4) AS total FROM m GROUP BY user_id, s")
def stream_sessions(spark, sf):
    """Sessions of half a day by timers over list state, the last open ones read from the state store."""
    found, _ = runs.run_sessions(stream(spark, sf, "events"), shared_folder(spark, "sessions"), "user_id", "ts", "value", 43200.0)
    return found.select(F.col("key").alias("user"), "start_us", "last_us", "n", F.round("total", 4).alias("total"))


@query("SELECT event_type AS kind, epoch_us(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01')) AS start_us, count(*) AS n FROM events GROUP BY ALL")
def stream_bins(spark, sf):
    """Tumbling counts by kind."""
    found = runs.run_bins(stream(spark, sf, "events"), shared_folder(spark, "bins"), "event_type", "ts", "6 hours")
    return found.select(F.col("key").alias("kind"), F.unix_micros("start").alias("start_us"), "n")
