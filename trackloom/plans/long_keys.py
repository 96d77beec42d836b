"""Registered queries of operators that deal out the rows of one very long key, with DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.operators import timeseries as ts
from trackloom.plans.kinematics import GEO, geometry
from trackloom.plans.queries import SIGNAL, query, signal

#: Width of a time bucket in seconds.
BUCKET_S = 6 * 3600.0

# all events are one key: its samples are the purchases
ONE_KEY = f"{SIGNAL}, have AS (SELECT t, max(value) AS v FROM sig WHERE event_type = 'purchase' GROUP BY 1), b AS (SELECT a.event_id, a.t, h.t AS bt, h.v AS bv FROM sig a ASOF LEFT JOIN have h ON a.t >= h.t), ba AS (SELECT b.*, h.t AS nt, h.v AS nv FROM b ASOF LEFT JOIN have h ON b.t <= h.t)"


def _one_key(spark, sf):
    d = signal(spark, sf).withColumn("key", F.lit("all"))
    return d.select("key", "event_id", "t"), d.filter("event_type = 'purchase'").select("key", "t", F.col("value").alias("v"))


@query(f"WITH {ONE_KEY} SELECT event_id, t, round(CASE WHEN bt IS NULL OR nt IS NULL THEN coalesce(bv, nv) WHEN nt > bt THEN bv + (t - bt) / (nt - bt) * (nv - bv) ELSE bv END, 6) AS v FROM ba")
def interpolation_join_long_key(spark, sf):
    """D1 where one key holds all rows: dealt out by time buckets."""
    return ts.interpolation_join(*_one_key(spark, sf), "key", "t", ["v"], edge="clamp", bucket=BUCKET_S).select("event_id", "t", F.round("v", 6).alias("v"))


@query(f"WITH {ONE_KEY}, n AS (SELECT *, bt IS NOT NULL AND (nt IS NULL OR t - bt <= nt - t) AS back FROM ba) SELECT event_id, t, CASE WHEN abs(t - CASE WHEN back THEN bt ELSE nt END) <= 900 THEN CASE WHEN back THEN bt ELSE nt END END AS matched_time, CASE WHEN abs(t - CASE WHEN back THEN bt ELSE nt END) <= 900 THEN CASE WHEN back THEN bv ELSE nv END END AS v FROM n")
def nearest_join_long_key(spark, sf):
    """D2 where one key holds all rows."""
    return ts.nearest_join(*_one_key(spark, sf), "key", "t", ["v"], 900.0, bucket=BUCKET_S).select("event_id", "t", "matched_time", "v")


def _decay(d, key: str, bucket: float):
    """Existence decays by 0.97 a step of 10,000 s and gains at every event by its quality."""
    w = ts.ordered(key, "t", "event_id")
    gain = 0.5 + 0.45 * ((1 + F.col("user_id") % 15) - 1) / 14
    d = d.withColumns({"gain": gain, "idle": F.coalesce(F.pow(F.lit(0.97), ts.difference("t", w) / 10000.0), F.lit(1.0))})
    hit = F.col("event_type") != "error"
    d = d.withColumns({"a": F.when(hit, 1 - F.col("gain")).otherwise(1.0) * F.col("idle"), "b": F.when(hit, F.col("gain")).otherwise(0.0), "start": 0.1 + 0.7 * (F.col("user_id") % 15) / 14, "bucket": F.floor(F.col("t") / bucket)})
    return ts.affine_scan(d, key, ["t", "event_id"], "a", "b", "start", "bucket", "prob")


DECAY = """e AS (
  SELECT event_id, {key} AS key, t, row_number() OVER w AS k, coalesce(pow(0.97, (t - lag(t) OVER w) / 10000.0), 1.0) AS idle,
         CASE WHEN event_type <> 'error' THEN 0.5 + 0.45 * (user_id % 15) / 14 ELSE 0.0 END::DOUBLE AS gain, (0.1 + 0.7 * (user_id % 15) / 14)::DOUBLE AS start
  FROM p WINDOW w AS (PARTITION BY {key} ORDER BY t, event_id)
), r AS (
  SELECT key, k, event_id, start * idle * (1 - gain) + gain AS prob FROM e WHERE k = 1
  UNION ALL SELECT e.key, e.k, e.event_id, r.prob * e.idle * (1 - e.gain) + e.gain FROM r JOIN e ON e.key = r.key AND e.k = r.k + 1
)"""


@query(f"WITH RECURSIVE {GEO}, {DECAY.format(key='user_id')} SELECT event_id, round(prob, 9) AS prob FROM r")
def existence_decay(spark, sf):
    """N2 over many steps: existence of each user's track after every event, a gain at each hit, decay in between."""
    return _decay(geometry(spark, sf), "user_id", 5 * 86400.0).select("event_id", F.round("prob", 9).alias("prob"))
