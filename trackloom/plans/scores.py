"""Registered queries of assignment and scores over frames of events, with DuckDB equivalents.

Ten neighbouring users are a scenario and eight hours a frame; a user's last click in a frame is a track, their last purchase a
target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions import scalars as s
from trackloom.operators import matching, scoring
from trackloom.plans.kinematics import GEO, geometry
from trackloom.plans.queries import query

FRAME_S, GATE = 28800.0, 4000.0


def frames(spark, sf) -> tuple[DataFrame, DataFrame]:
    d = geometry(spark, sf).select(F.floor(F.col("user_id") / 10).alias("scenario"), F.floor(F.col("t") / FRAME_S).alias("time"), "user_id", "event_type", "event_id", F.col("dx").alias("x"), F.col("dy").alias("y"), F.col("dz").alias("z"), "vx", "vy", "vz")
    last = lambda kind, name: d.filter(F.col("event_type") == kind).groupBy("scenario", "time", F.col("user_id").alias(name)).agg(F.max_by(F.struct("x", "y", "z", "vx", "vy", "vz"), "event_id").alias("s")).select("scenario", "time", name, "s.*")
    tracks, targets = last("click", "global_track_id"), last("purchase", "callsign")
    quality = 1 + F.col("global_track_id") % 15
    sigma, speed = s.quality_to_sigma(quality, s.POSITION_SIGMA), 1 + F.col("global_track_id") % 3
    return tracks.withColumns({"pos_sigma_m": sigma, "vel_sigma_mps": speed.cast("double")} | {c: F.lit(None).cast("double") for c in scoring.SIGMAS}), targets


# the smaller side of a frame picks of the larger one, one after the other, in every way
FRAMES = f"""
{GEO}, e AS (
  SELECT (user_id // 10)::BIGINT AS scenario, floor(t / 28800)::BIGINT AS time, user_id, event_type = 'click' AS track, arg_max({{'x': dx, 'y': dy, 'z': dz, 'vx': vx, 'vy': vy, 'vz': vz}}, event_id) AS s
  FROM p WHERE event_type IN ('click', 'purchase') GROUP BY ALL
), sides AS (
  SELECT *, row_number() OVER (PARTITION BY scenario, time, track ORDER BY user_id) - 1 AS k,
         count(*) FILTER (track) OVER (PARTITION BY scenario, time) AS na, count(*) FILTER (NOT track) OVER (PARTITION BY scenario, time) AS nb FROM e
), pairs AS (
  SELECT a.scenario, a.time, a.user_id AS a, b.user_id AS b, CASE WHEN a.na <= a.nb THEN a.k ELSE b.k END AS i, CASE WHEN a.na <= a.nb THEN b.k ELSE a.k END AS j, least(a.na, a.nb) AS n,
         sqrt(pow(a.s.x - b.s.x, 2) + pow(a.s.y - b.s.y, 2) + pow(a.s.z - b.s.z, 2)) AS d
  FROM sides a JOIN sides b ON a.scenario = b.scenario AND a.time = b.time AND a.track AND NOT b.track
), paths AS (
  SELECT DISTINCT scenario, time, n, 0::BIGINT AS i, 0::BIGINT AS mask, 0.0::DOUBLE AS cost, []::STRUCT(a BIGINT, b BIGINT, d DOUBLE)[] AS picks FROM pairs
  UNION ALL
  SELECT q.scenario, q.time, q.n, q.i + 1, q.mask + (1::BIGINT << p.j), q.cost + p.d, list_append(q.picks, {{'a': p.a, 'b': p.b, 'd': p.d}})
  FROM paths q JOIN pairs p ON q.scenario = p.scenario AND q.time = p.time AND q.i = p.i AND (q.mask >> p.j) % 2 = 0
), best AS (
  SELECT scenario, time, unnest(arg_min(picks, cost)) AS p FROM paths WHERE i = n GROUP BY scenario, time
), hit AS (
  SELECT scenario, time, p.a AS a, p.b AS b, p.d AS d FROM best WHERE p.d <= 4000
), matches AS (
  SELECT scenario, time, a, b, d FROM hit
  UNION ALL SELECT scenario, time, user_id, NULL, NULL FROM sides s WHERE track AND NOT EXISTS (FROM hit h WHERE h.scenario = s.scenario AND h.time = s.time AND h.a = s.user_id)
  UNION ALL SELECT scenario, time, NULL, user_id, NULL FROM sides s WHERE NOT track AND NOT EXISTS (FROM hit h WHERE h.scenario = s.scenario AND h.time = s.time AND h.b = s.user_id)
)"""


@query(f"WITH RECURSIVE {FRAMES} SELECT scenario, time, a AS global_track_id, b AS callsign, round(d, 6) AS distance FROM matches")
def hungarian_match(spark, sf):
    """D3, M7: least total distance between the tracks and the targets of each frame, gated afterwards."""
    tracks, targets = frames(spark, sf)
    return matching.assigned(tracks, targets, ["scenario", "time"], "global_track_id", "callsign", GATE).withColumn("distance", F.round("distance", 6))


ERRORS = """
errors AS (
  SELECT m.*, f.s.x - g.s.x AS ex, f.s.y - g.s.y AS ey, f.s.z - g.s.z AS ez, f.s.vx - g.s.vx AS evx, f.s.vy - g.s.vy AS evy, f.s.vz - g.s.vz AS evz,
         1500.0 * pow(30.0 / 1500.0, (a % 15) / 14.0) AS sp, (1 + a % 3)::DOUBLE AS sv
  FROM {matches} m LEFT JOIN sides f ON f.track AND f.scenario = m.scenario AND f.time = m.time AND f.user_id = m.a
  LEFT JOIN sides g ON NOT g.track AND g.scenario = m.scenario AND g.time = m.time AND g.user_id = m.b
)"""
QUALITY = """round(sqrt(avg(ex * ex + ey * ey + ez * ez)), 6) AS rmse_pos_m, round(sqrt(avg(evx * evx + evy * evy + evz * evz)), 6) AS rmse_vel_mps,
 round(sqrt(avg(ex * ex)), 6) AS rmse_x_m, round(sqrt(avg(ey * ey)), 6) AS rmse_y_m, round(sqrt(avg(ez * ez)), 6) AS rmse_z_m, round(sqrt(avg(evx * evx)), 6) AS rmse_vx_mps,
 round(sqrt(avg(evy * evy)), 6) AS rmse_vy_mps, round(sqrt(avg(evz * evz)), 6) AS rmse_vz_mps, round(avg((ex * ex + ey * ey + ez * ez) / (sp * sp) + (evx * evx + evy * evy + evz * evz) / (sv * sv)), 6) AS nees"""
RATES = """round(coalesce(total_tp / nullif(total_tp + total_fp, 0), 0), 9) AS precision, round(coalesce(total_tp / nullif(total_gt, 0), 0), 9) AS recall"""


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    """Scores to six digits, rates to nine."""
    digits = {c: 9 if c in ("precision", "recall", "id_precision", "f1_score", "id_f1", "mota") else 6 for c, kind in df.dtypes if kind == "double"}
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()}).select(*keep)


COUNTS = ("total_tp", "total_fp", "total_fn", "total_gt", "id_switches")
MEANS = ("rmse_pos_m", "rmse_vel_mps", "rmse_x_m", "rmse_y_m", "rmse_z_m", "rmse_vx_mps", "rmse_vy_mps", "rmse_vz_mps", "nees")


@query(f"""WITH RECURSIVE {FRAMES}, turned AS (
  SELECT *, coalesce(a IS NOT NULL AND b <> lag(b) OVER (PARTITION BY scenario, a ORDER BY time), false) AS sw FROM matches
), {ERRORS.format(matches="turned")}, c AS (
  SELECT scenario, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS total_tp, count(*) FILTER (b IS NULL) AS total_fp, count(*) FILTER (a IS NULL) AS total_fn,
         count(*) FILTER (b IS NOT NULL) AS total_gt, count(*) FILTER (sw AND a IS NOT NULL) AS id_switches, {QUALITY} FROM errors GROUP BY scenario
), r AS (
  SELECT *, coalesce(total_tp / nullif(total_tp + total_fp, 0), 0) AS p, coalesce(total_tp / nullif(total_gt, 0), 0) AS q, coalesce((total_tp - id_switches) / nullif(total_tp + total_fp, 0), 0) AS o FROM c
)
SELECT * EXCLUDE (p, q, o), round(p, 9) AS precision, round(q, 9) AS recall, round(o, 9) AS id_precision, round(coalesce(2 * p * q / nullif(p + q, 0), 0), 9) AS f1_score,
       round(coalesce(2 * o * q / nullif(o + q, 0), 0), 9) AS id_f1, round(coalesce(1 - (total_fn + total_fp + id_switches) / nullif(total_gt, 0), 0), 9) AS mota FROM r""")
def mot_scores(spark, sf):
    """P1, E10-E13 on given tracks: counts, identity switches, rates, errors by axis, normalised errors of each scenario."""
    return rounded(scoring.frame_scores(*frames(spark, sf), GATE), "scenario", *COUNTS, *MEANS, "precision", "recall", "id_precision", "f1_score", "id_f1", "mota")


@query(f"""WITH {GEO}, {FRAMES[FRAMES.index("e AS"):FRAMES.index("pairs AS")].rstrip().rstrip(",")}, near AS (
  SELECT g.scenario, g.time, g.user_id AS b, f.user_id AS a, sqrt(pow(f.s.x - g.s.x, 2) + pow(f.s.y - g.s.y, 2) + pow(f.s.z - g.s.z, 2)) AS d
  FROM sides g LEFT JOIN sides f ON f.track AND f.scenario = g.scenario AND f.time = g.time AND sqrt(pow(f.s.x - g.s.x, 2) + pow(f.s.y - g.s.y, 2) + pow(f.s.z - g.s.z, 2)) <= 4000 WHERE NOT g.track
), best AS (
  SELECT scenario, time, b, arg_min(a, (d, a)) AS a, count(a) AS n FROM near GROUP BY ALL
), {ERRORS.format(matches="best")}
SELECT scenario, b AS callsign, count(a) AS total_tp, (sum(n) - count(a))::BIGINT AS total_fp, count(*) - count(a) AS total_fn, count(*) AS total_gt, 0::BIGINT AS id_switches, {QUALITY},
       round(coalesce(count(a) / nullif(sum(n), 0), 0), 9) AS precision, round(count(a) / count(*), 9) AS recall FROM errors GROUP BY ALL""")
def target_scores(spark, sf):
    """P2 on given tracks: each target by itself, the nearest track within the gate against the others."""
    return rounded(scoring.target_scores(*frames(spark, sf), GATE), "scenario", "callsign", *COUNTS, *MEANS, "precision", "recall")


@query(f"WITH {GEO}, q AS (SELECT event_id, dx, vx, dy, vy, dz, vz, 1500.0 * pow(30.0 / 1500.0, (user_id % 15) / 14.0) AS sp, (1 + user_id % 3)::DOUBLE AS sv FROM p) SELECT event_id, round((dx * dx + dy * dy + dz * dz) / (sp * sp) + (vx * vx + vy * vy + vz * vz) / (sv * sv), 6) AS nees FROM q")
def nees_diag(spark, sf):
    """Errors normalised by diagonal covariances, summed over the six axes."""
    d = geometry(spark, sf)
    sp, sv = s.quality_to_sigma(1 + F.col("user_id") % 15, s.POSITION_SIGMA), (1 + F.col("user_id") % 3).cast("double")
    both = [(c, sp) for c in ("dx", "dy", "dz")] + [(c, sv) for c in ("vx", "vy", "vz")]
    return d.select("event_id", F.round(s.diagonal_distance([F.col(c) for c, _ in both], [v * v for _, v in both]), 6).alias("nees"))
