"""Registered queries of derived paths, covariances and associations of given tracks, with DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import arrays as m
from trackloom.operators import generators as g
from trackloom.operators import paths, scoring
from trackloom.operators import timeseries as ts
from trackloom.plans.kinematics import GEO, geometry
from trackloom.plans.queries import query, table

ROUTE = "r AS (SELECT user_id // 10 AS scenario, user_id AS callsign, event_id, (t - 1704067200) / 10000 AS time, dx AS x, dy AS y, vx, vy FROM p), c AS (SELECT scenario, avg(x) AS cx, avg(y) AS cy FROM r GROUP BY 1)"


def routes(spark, sf):
    d = geometry(spark, sf)
    return d.select(F.floor(F.col("user_id") / 10).alias("scenario"), F.col("user_id").alias("callsign"), "event_id", ((F.col("t") - 1704067200) / 10000).alias("time"), F.col("dx").alias("x"), F.col("dy").alias("y"), "vx", "vy")


@query(f"WITH {GEO}, {ROUTE} SELECT event_id, round(2 * cx - x, 6) AS x, -vx + 0.0 AS vx, y, vy FROM r JOIN c USING (scenario)")
def mirror_route(spark, sf):
    """Paths reflected about the mean of their scenario."""
    return g.mirror_route(routes(spark, sf), "M").select("event_id", F.round("x", 6).alias("x"), (F.col("vx") + 0.0).alias("vx"), "y", "vy")


@query(f"WITH {GEO}, {ROUTE} SELECT event_id, round(2 * cy - y + 3000 * sin(2 * pi() / 100 * time), 4) AS y, round(-vy + 3000 * (2 * pi() / 100) * cos(2 * pi() / 100 * time), 4) AS vy, round(2 * cx - x + 15000 * sin(2 * pi() / 50 * time), 4) AS x, round(-vx + 15000 * (2 * pi() / 50) * cos(2 * pi() / 50 * time), 4) AS vx FROM r JOIN c USING (scenario)")
def weave_routes(spark, sf):
    """A smooth sine across y and a sharp one across x, on mirrored paths."""
    d = routes(spark, sf)
    smooth, sharp = g.weave_route(d, "S", 3000.0, 100.0, "y"), g.weave_route(d, "X", 15000.0, 50.0, "x")
    return smooth.select("event_id", F.round("y", 4).alias("y"), F.round("vy", 4).alias("vy")).join(sharp.select("event_id", F.round("x", 4).alias("x"), F.round("vx", 4).alias("vx")), "event_id")


POINTS = f"""{GEO}, q AS (
  SELECT user_id, t AS time_unix, CASE WHEN event_type <> 'error' THEN 40 + value / 1000 END AS lat, 30 + dy / 100000 AS lon, CASE WHEN event_type <> 'signup' THEN dz ELSE 0 END AS alt FROM p
), f AS (
  SELECT user_id, time_unix, min({{'lat': lat, 'lon': lon, 'alt': alt}}) AS s FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM q WHERE lat IS NOT NULL) WHERE n >= 5 GROUP BY 1, 2
), a AS (
  SELECT user_id, median(s.lat) AS lat0, median(s.lon) AS lon0, median(s.alt) AS alt0, min(time_unix) AS t0 FROM f GROUP BY 1
), e AS (
  SELECT user_id, time_unix - t0 AS time, radians(s.lon - lon0) * 6371000.0 * cos(radians(lat0)) AS x, radians(s.lat - lat0) * 6371000.0 AS y, s.alt - alt0 AS z FROM f JOIN a USING (user_id)
), v AS (
  SELECT *, greatest(coalesce(time - lag(time) OVER w, 1.0), 0.1) AS dt, x - lag(x) OVER w AS ex, y - lag(y) OVER w AS ey, z - lag(z) OVER w AS ez FROM e WINDOW w AS (PARTITION BY user_id ORDER BY time)
), c AS (
  SELECT *, greatest(-350, least(350, coalesce(ex / dt, 0))) AS wx, greatest(-350, least(350, coalesce(ey / dt, 0))) AS wy, greatest(-350, least(350, coalesce(ez / dt, 0))) AS wz FROM v
)"""


@query(f"WITH {POINTS} SELECT user_id, round(time, 6) AS time, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y, round(z, 4)::DOUBLE AS z, " + ", ".join(f"round(avg(w{c}) OVER (PARTITION BY user_id ORDER BY time ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) + 0.0 AS v{c}" for c in "xyz") + " FROM c")
def truth_of_paths(spark, sf):
    """Truth from positions of many paths: medians, local metres, clipped and smoothed velocities."""
    d = geometry(spark, sf)
    points = d.select("user_id", F.col("t").alias("time_unix"), F.when(F.col("event_type") != "error", 40 + F.col("value") / 1000).alias("lat"), (30 + F.col("dy") / 100000).alias("lon"), F.when(F.col("event_type") != "signup", F.col("dz")).alias("alt_m"))
    found = paths.truth_of_paths(points, "user_id")
    return found.select("user_id", F.round("time", 6).alias("time"), *((F.round(c, 4) + 0.0).alias(c) for c in "xyz"), *((F.round(f"v{c}", 6) + 0.0).alias(f"v{c}") for c in "xyz"))


@query(f"""WITH {GEO}, q AS (SELECT event_id, r, cos(el) AS ce, sin(el) AS se, cos(az) AS ca, sin(az) AS sa, pow(5 + user_id % 7, 2) AS vr, pow(0.001 * (1 + user_id % 3), 2) AS va, pow(0.002, 2) AS ve FROM p)
SELECT event_id, round(ce * ca * ce * ca * vr + r * ce * sa * r * ce * sa * va + r * se * ca * r * se * ca * ve, 6) AS xx, round(ce * ca * ce * sa * vr - r * ce * sa * r * ce * ca * va + r * se * ca * r * se * sa * ve, 6) + 0.0 AS xy,
 round(ce * ca * se * vr - r * se * ca * r * ce * ve, 6) + 0.0 AS xz, round(ce * sa * ce * sa * vr + r * ce * ca * r * ce * ca * va + r * se * sa * r * se * sa * ve, 6) AS yy, round(ce * sa * se * vr - r * se * sa * r * ce * ve, 6) + 0.0 AS yz, round(se * se * vr + r * ce * r * ce * ve, 6) AS zz FROM q""")
def polar_covariances(spark, sf):
    """I4: covariances of places measured in polar coordinates."""
    d = geometry(spark, sf)
    p = m.polar_covariance(F.col("r"), F.col("az"), F.col("el"), (5 + F.col("user_id") % 7).cast("double"), 0.001 * (1 + F.col("user_id") % 3), F.lit(0.002))
    d = d.select("event_id", p.alias("p"))
    return d.select("event_id", *((F.round(F.get(F.get("p", F.lit(i)), F.lit(k)), 6) + 0.0).alias(n) for n, i, k in (("xx", 0, 0), ("xy", 0, 1), ("xz", 0, 2), ("yy", 1, 1), ("yz", 1, 2), ("zz", 2, 2))))


# a user's purchases are the target, their other events a track of each kind
ASSOCIATED = f"""{GEO}, f AS (SELECT user_id, event_type, event_id, t, dx, dy, dz FROM p WHERE event_type <> 'purchase'), h AS (SELECT user_id, t, dx, dy, dz FROM p WHERE event_type = 'purchase'),
b AS (SELECT f.*, h.t AS bt, h.dx AS bx, h.dy AS by_, h.dz AS bz FROM f ASOF LEFT JOIN h ON f.user_id = h.user_id AND f.t >= h.t), n AS (SELECT b.*, h.t AS nt, h.dx AS nx, h.dy AS ny, h.dz AS nz FROM b ASOF LEFT JOIN h ON b.user_id = h.user_id AND b.t <= h.t),
w AS (SELECT *, bt IS NOT NULL AND (nt IS NULL OR t - bt <= nt - t) AS back FROM n), d AS (SELECT user_id, event_type, event_id, t, sqrt(pow(dx - CASE WHEN back THEN bx ELSE nx END, 2) + pow(dy - CASE WHEN back THEN by_ ELSE ny END, 2) + pow(dz - CASE WHEN back THEN bz ELSE nz END, 2)) AS error FROM w WHERE abs(t - CASE WHEN back THEN bt ELSE nt END) <= 172800),
a AS (SELECT * FROM d WHERE error <= 6000 QUALIFY count(*) OVER (PARTITION BY user_id, event_type) >= 2),
s AS (SELECT *, t - lag(t) OVER v AS gap FROM a WINDOW v AS (PARTITION BY user_id, event_type ORDER BY t)), k AS (SELECT *, sum(CASE WHEN gap > 259200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY t ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM s)"""


@query(f"WITH {ASSOCIATED} SELECT user_id || '/' || event_type AS key, segment, min(t) AS start, max(t) AS \"end\", count(*) AS n, max(t) - min(t) AS duration, max(CASE WHEN gap <= 259200 THEN gap END) AS max_gap, round(avg(error), 6) AS mean_error, round(max(error), 6) AS max_error FROM k GROUP BY 1, 2")
def association_segments(spark, sf):
    """Given tracks associated with a target, their segments with mean and largest errors."""
    d = geometry(spark, sf).select(F.col("user_id").cast("string").alias("scenario"), "event_type", F.col("t").alias("time"), F.col("dx").alias("x"), F.col("dy").alias("y"), F.col("dz").alias("z"), "vx", "vy", "vz")
    tracks = d.filter("event_type <> 'purchase'").withColumnRenamed("event_type", "global_track_id")
    found = scoring.associate_target(tracks, d.filter("event_type = 'purchase'").drop("event_type"), 6000.0, 172800.0)
    return scoring.association_segments(found, 259200.0).withColumns({c: F.round(c, 6) for c in ("mean_error", "max_error")})


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT * FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey DESC, l_linenumber DESC LIMIT 12)")
def last_rows(spark, sf):
    """The tail of an order."""
    return ts.last_rows(table(spark, sf, "lineitem"), ["l_extendedprice", "l_orderkey", "l_linenumber"], 12).select("l_orderkey", "l_linenumber", "l_extendedprice")
