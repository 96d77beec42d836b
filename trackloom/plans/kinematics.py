"""Registered queries of the geometry, gating and bookkeeping of tracks over the driver's tables, with DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackloom.functions import scalars as s
from trackloom.operators import generators as g
from trackloom.operators import scoring
from trackloom.operators import timeseries as ts
from trackloom.plans.queries import SIGNAL, query, signal, table
from trackloom.sources import files

GEO = "g AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1e6 AS t, value * 100 AS dx, (CAST(json_extract(props, '$.k') AS BIGINT) - 40) * 37.5 AS dy, (user_id % 90) * 50.0 AS dz, value - 50 AS vx, user_id % 31 - 15.0 AS vy, event_id % 7 - 3.0 AS vz FROM events), p AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS r, atan2(dy, dx) AS az, atan2(dz, greatest(sqrt(dx * dx + dy * dy), 1e-6)) AS el FROM g)"


def geometry(spark, sf):
    """Every event as a place and a velocity as a radar at the origin sees them."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    d = e.select("event_id", "user_id", "event_type", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), (F.col("value") * 100).alias("dx"), ((k - 40) * 37.5).alias("dy"), ((F.col("user_id") % 90) * 50.0).alias("dz"), (F.col("value") - 50).alias("vx"), (F.col("user_id") % 31 - 15.0).alias("vy"), (F.col("event_id") % 7 - 3.0).alias("vz"))
    r, az, el = s.to_polar(F.col("dx"), F.col("dy"), F.col("dz"))
    return d.withColumns({"r": r, "az": az, "el": el})


@query(f"WITH {GEO} SELECT event_id, round(r, 6) AS r, round(az, 9) AS az, round(el, 9) AS el, round(r * cos(el) * cos(az), 4) + 0.0 AS x, round(r * cos(el) * sin(az), 4) + 0.0 AS y, round(r * sin(el), 4) + 0.0 AS z FROM p")
def polar_round_trip(spark, sf):
    """B13 without noise: place to range, azimuth, elevation and back."""
    d = geometry(spark, sf)
    along = s.sight_axes(F.col("az"), F.col("el"))[0]
    return d.select("event_id", F.round("r", 6).alias("r"), F.round("az", 9).alias("az"), F.round("el", 9).alias("el"), *((F.round(F.col("r") * u, 4) + 0.0).alias(c) for c, u in zip("xyz", along)))


@query(f"WITH {GEO}, q AS (SELECT *, cos(el) * cos(az) * vx + cos(el) * sin(az) * vy + sin(el) * vz AS m0, -sin(az) * vx + cos(az) * vy AS m1, -sin(el) * cos(az) * vx - sin(el) * sin(az) * vy + cos(el) * vz AS m2 FROM p) SELECT event_id, round(m0, 6) + 0.0 AS along, round(m1, 6) + 0.0 AS across, round(m2, 6) + 0.0 AS up, round(sqrt(m0 * m0 + m1 * m1 + m2 * m2), 6) AS speed FROM q")
def doppler_projection(spark, sf):
    """B14 without noise: velocities along the line of sight, across and up."""
    d = geometry(spark, sf)
    m = s.project([F.col(c) for c in ("vx", "vy", "vz")], s.sight_axes(F.col("az"), F.col("el")))
    d = d.withColumns({f"m{k}": c for k, c in enumerate(m)})
    return d.select("event_id", *((F.round(f"m{k}", 6) + 0.0).alias(n) for k, n in enumerate(("along", "across", "up"))), F.round(s.speed(F.col("m0"), F.col("m1"), F.col("m2")), 6).alias("speed"))


@query(f"WITH {GEO}, a AS (SELECT *, ((degrees(az) % 360) + 360) % 360 AS deg FROM p) SELECT event_id, r <= 7000 AND (deg >= 300 OR deg <= 41) AND degrees(el) BETWEEN -10 AND 45 AS wrapped, r <= 9000 AND deg >= 10 AND deg <= 90 AND degrees(el) BETWEEN 1 AND 30 AS sector, r <= 5000 AND degrees(el) BETWEEN -90 AND 90 AS whole FROM a")
def field_of_view(spark, sf):
    """Range, azimuth sector (over north too) and elevation band."""
    view = lambda *x: s.in_view(F.col("dx"), F.col("dy"), F.col("dz"), *x)
    return geometry(spark, sf).select("event_id", view(7000.0, (-60.0, 41.0), (-10.0, 45.0)).alias("wrapped"), view(9000.0, (10.0, 90.0), (1.0, 30.0)).alias("sector"), view(5000.0, (-180.0, 180.0), (-90.0, 90.0)).alias("whole"))


@query(f"WITH {GEO} SELECT event_id, round(CASE WHEN r <= 2000 THEN 0.95 WHEN r >= 8000 THEN 0.3 ELSE 0.95 - (0.95 - 0.3) * (r - 2000) / 6000 END::DOUBLE, 9) AS chance FROM p")
def range_detection(spark, sf):
    """Chance of detection falling with range."""
    return geometry(spark, sf).select("event_id", F.round(s.range_dependent_pd(F.col("r"), 0.95, 2000.0, 8000.0, 0.3), 9).alias("chance"))


@query(f"WITH {GEO}, d AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, coalesce(vx - lag(vx) OVER w, 0) AS ax, coalesce(vz - lag(vz) OVER w, 0) AS az1 FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t)) SELECT event_id, n >= 3 AND sqrt(ax * ax + az1 * az1) > 5 AS turning FROM d")
def manoeuvre_flags(spark, sf):
    """A change of velocity over 5 m/s since the target's row before."""
    d = geometry(spark, sf).select(F.lit("all").alias("scenario"), F.col("user_id").alias("callsign"), F.col("t").alias("time"), "event_id", "vx", F.col("vz").alias("vy"))
    return g.maneuvering(d).select("event_id", (F.hypot("dvx", "dvy") > 5.0).alias("turning"))


NAMES = "n AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'RADAR_' || chr(CAST(65 + user_id % 5 AS INTEGER)) WHEN 1 THEN ' sensor-b_' || event_type || ' ' WHEN 2 THEN 'a_c-' || event_type WHEN 3 THEN 'rdr' || chr(CAST(97 + user_id % 4 AS INTEGER)) WHEN 4 THEN '' END AS name FROM events)"


@query(f"WITH {NAMES}, t AS (SELECT event_id, name, upper(trim(name)) AS u, list_filter(string_split(replace(upper(trim(name)), '-', '_'), '_'), lambda x: x IN ('A', 'B', 'C')) AS hits FROM n) SELECT event_id, name, CASE WHEN len(hits) > 0 THEN hits[len(hits)] WHEN right(u, 1) IN ('A', 'B', 'C') THEN right(u, 1) ELSE 'OTHER' END AS bucket FROM t")
def radar_buckets(spark, sf):
    """I16: radar classes from names of several styles."""
    n = F.col("event_id") % 6
    letter = lambda base, k: F.char((F.lit(base) + F.col("user_id") % k).cast("int"))
    name = F.when(n == 0, F.concat(F.lit("RADAR_"), letter(65, 5))).when(n == 1, F.concat(F.lit(" sensor-b_"), "event_type", F.lit(" "))).when(n == 2, F.concat(F.lit("a_c-"), "event_type")).when(n == 3, F.concat(F.lit("rdr"), letter(97, 4))).when(n == 4, "")
    return table(spark, sf, "events").select("event_id", name.alias("name")).withColumn("bucket", s.radar_bucket(F.col("name")))


@query(f"WITH {GEO}, q AS (SELECT *, 10 + user_id % 7 AS sp, 1 + user_id % 3 AS sv, CASE WHEN event_type = 'error' THEN NULL ELSE dz END AS z FROM p) SELECT event_id, (sp * sp)::DOUBLE AS pos, (sv * sv)::DOUBLE AS vel, 0.0::DOUBLE AS off, round(CASE WHEN z IS NULL THEN 1e6 ELSE sp * sp + pow(0.005 * sqrt(dx * dx + dy * dy), 2) END, 6) AS height, round((CASE WHEN z IS NULL THEN 1e6 ELSE pow(1.5 * sv, 2) END)::DOUBLE, 6) AS climb FROM q")
def measurement_covariances(spark, sf):
    """The 6 x 6 diagonal of sigmas, and the vertical variances with and without heights."""
    d = geometry(spark, sf).withColumns({"sp": (10 + F.col("user_id") % 7).cast("double"), "sv": (1 + F.col("user_id") % 3).cast("double"), "z": F.when(F.col("event_type") != "error", F.col("dz"))})
    m = s.diagonal_covariance(F.col("sp"), F.col("sv"))
    height, climb = s.vertical_variances(F.col("sp"), F.col("sv"), F.col("dx"), F.col("dy"), F.col("z"))
    return d.select("event_id", F.get(m, F.lit(14)).alias("pos"), F.get(m, F.lit(21)).alias("vel"), F.get(m, F.lit(1)).alias("off"), F.round(height, 6).alias("height"), F.round(climb, 6).alias("climb"))


STEP = f"{GEO}, d AS (SELECT *, t - lag(t) OVER w AS gap, dx - lag(dx) OVER w AS ex, dy - lag(dy) OVER w AS ey, dz - lag(dz) OVER w AS ez, vx - lag(vx) OVER w AS fx, vy - lag(vy) OVER w AS fy, vz - lag(vz) OVER w AS fz, lag(dx) OVER w AS px, lag(vx) OVER w AS pv FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)), e AS (SELECT *, gap / 10000.0 AS dt FROM d WHERE gap IS NOT NULL)"


def steps(spark, sf):
    """Each event beside its user's event before."""
    w = ts.ordered("user_id", "t", "event_id")
    d = geometry(spark, sf).withColumn("gap", ts.difference("t", w))
    d = d.withColumns({a: ts.difference(b, w) for a, b in zip(("ex", "ey", "ez", "fx", "fy", "fz"), ("dx", "dy", "dz", "vx", "vy", "vz"))} | {"px": F.lag("dx").over(w), "pv": F.lag("vx").over(w)})
    return d.filter("gap is not null").withColumn("dt", F.col("gap") / 10000.0)


@query(f"WITH {STEP} SELECT event_id, round(ex * ex / 900 + ey * ey / 2500 + ez * ez / 400, 6) AS d2, ex * ex / 900 + ey * ey / 2500 + ez * ez / 400 < 13.931422665512084 AS near, sqrt(ex * ex + ey * ey + ez * ez) <= greatest(750, 3 * sqrt(3800)) AND sqrt(fx * fx + fy * fy + fz * fz) <= 120 AND greatest(0, sqrt(fx * fx + fy * fy + fz * fz) - 3 * sqrt(75)) / greatest(dt, 1) <= 30 AS fits FROM e")
def association_gates(spark, sf):
    """M2, M3, J3 for diagonal covariances: distance and physical gates between an event and the one before."""
    d2 = s.diagonal_distance([F.col(c) for c in ("ex", "ey", "ez")], [F.lit(900.0), F.lit(2500.0), F.lit(400.0)])
    away, turn = s.speed(F.col("ex"), F.col("ey"), F.col("ez")), s.speed(F.col("fx"), F.col("fy"), F.col("fz"))
    fits = s.physical_gate(away, turn, F.sqrt(F.lit(3800.0)), F.sqrt(F.lit(75.0)), F.col("dt"))
    return steps(spark, sf).select("event_id", F.round(d2, 6).alias("d2"), (d2 < 13.931422665512084).alias("near"), fits.alias("fits"))


@query(f"WITH {STEP} SELECT event_id, round(px + pv * dt, 6) AS ahead, round(100 + dt * dt * 4 + pow(0.5 * dt * dt, 2), 4) AS variance, round(0.8 * pow(0.97, dt), 9) AS prob, round(CASE WHEN value / 100 > 0.6 THEN least(22.5 * (1 + 0.8 * value / 100), 40.5) ELSE 22.5 END::DOUBLE, 6) AS gate FROM e")
def constant_velocity_prediction(spark, sf):
    """A constant-velocity step of state and variance, decay of existence, widened gate."""
    dt = F.col("dt")
    return steps(spark, sf).select("event_id", F.round(F.col("px") + F.col("pv") * dt, 6).alias("ahead"), F.round(100 + dt * dt * 4 + F.pow(0.5 * dt * dt, 2), 4).alias("variance"), F.round(0.8 * F.pow(F.lit(0.97), dt), 9).alias("prob"), F.round(s.effective_gate(F.col("value") / 100), 6).alias("gate"))


@query("WITH n AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'nan'::DOUBLE ELSE value END AS v, CASE WHEN event_type = 'error' THEN 'n/a' ELSE ' ' || replace(printf('%.2f', value), '.', ',') || ' ' END AS text FROM events) SELECT event_id, isfinite(v) AS fine, CASE WHEN isfinite(v) THEN abs(v - round(v)) <= 0.25 END AS whole, TRY_CAST(replace(trim(text), ',', '.') AS DOUBLE) AS number FROM n")
def finite_and_decimal(spark, sf):
    """Finite checks, closeness, numbers with a decimal comma."""
    bad = F.col("event_type") == "error"
    v = F.when(bad, F.lit(float("nan"))).otherwise(F.col("value"))
    text = F.when(bad, "n/a").otherwise(F.concat(F.lit(" "), F.replace(F.format_string("%.2f", "value"), F.lit("."), F.lit(",")), F.lit(" ")))
    d = table(spark, sf, "events").select("event_id", v.alias("v"), text.alias("text"))
    return d.select("event_id", s.finite(F.col("v")).alias("fine"), F.when(s.finite(F.col("v")), s.is_close(F.col("v"), F.round("v"), 0.25)).alias("whole"), s.decimal_comma(F.col("text")).alias("number"))


@query(f"WITH {SIGNAL} SELECT user_id, floor(t / 86400)::BIGINT AS day, event_id, abs(value - 50) AS error FROM sig QUALIFY row_number() OVER (PARTITION BY user_id, floor(t / 86400) ORDER BY abs(value - 50), event_id) = 1")
def best_states(spark, sf):
    """Of each time the associated row of least error."""
    d = signal(spark, sf).select(F.col("user_id").alias("scenario"), F.floor(F.col("t") / 86400).cast("long").alias("time"), F.abs(F.col("value") - 50).alias("position_error_m"), F.col("event_id").alias("global_track_id"))
    return scoring.best_state(d).select(F.col("scenario").alias("user_id"), F.col("time").alias("day"), F.col("global_track_id").alias("event_id"), F.col("position_error_m").alias("error"))


@query(f"WITH {SIGNAL}, n AS (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id) - 1 AS last, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS k FROM sig), picks AS (SELECT DISTINCT user_id, last, unnest(CASE WHEN last < 20 THEN range(last + 1) ELSE list_transform(range(20), lambda i: i * last // 19) END) AS k FROM (SELECT DISTINCT user_id, last FROM n)) SELECT n.user_id, n.event_id FROM n JOIN picks USING (user_id, k)")
def frame_pick(spark, sf):
    """Rows at equal steps from a key's first to its last."""
    return ts.evenly_picked(signal(spark, sf), ["t", "event_id"], 20, "user_id").select("user_id", "event_id")


@query(f"WITH {SIGNAL}, d AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS dv, t - lag(t) OVER (PARTITION BY user_id ORDER BY event_id) AS dt, value, t FROM sig) SELECT user_id, count(*) FILTER (dt < 0) = 0 AS time_rising, count(t) - count(DISTINCT t) AS time_repeated, count(*) FILTER (dv < 0) = 0 AS value_rising, count(value) - count(DISTINCT value) AS value_repeated FROM d GROUP BY 1")
def monotonic_checks(spark, sf):
    """whether a column never falls, and how often it repeats a value."""
    d = signal(spark, sf)
    return ts.monotonic_checks(d, "user_id", "event_id", {"time": "t", "value": "value"})


SCANS = f"{SIGNAL}, scans AS (SELECT DISTINCT user_id, t FROM sig WHERE event_type = 'purchase'), ask AS (SELECT user_id, event_id, t, event_type FROM sig), b AS (SELECT a.*, s.t AS bt FROM ask a ASOF LEFT JOIN scans s ON a.user_id = s.user_id AND a.t >= s.t), ba AS (SELECT b.*, s.t AS nt FROM b ASOF LEFT JOIN scans s ON b.user_id = s.user_id AND b.t <= s.t), m AS (SELECT *, CASE WHEN bt IS NULL AND nt IS NULL THEN t WHEN nt IS NULL OR t - bt <= nt - t THEN bt ELSE nt END AS moved FROM ba)"


@query(f"WITH {SCANS} SELECT user_id, event_id, moved AS t, event_type FROM m QUALIFY row_number() OVER (PARTITION BY user_id, moved, event_type ORDER BY t, event_id) = 1")
def scan_realignment(spark, sf):
    """Measurements moved to the nearest scan, one of each kind for a scan."""
    d = signal(spark, sf).select("user_id", "event_id", "t", "event_type")
    return ts.realigned(d, d.filter("event_type = 'purchase'"), "user_id", "t", ["event_type"], ["event_id"])


@query("SELECT event_id, user_id, event_type, value FROM events WHERE event_type IS DISTINCT FROM 'purchase' UNION ALL SELECT event_id, user_id, 'purchase', value * 2 FROM events WHERE event_type = 'purchase'")
def replace_rows(spark, sf):
    """One target's rows replaced, all others unchanged."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return files.replace_target(e, e.filter("event_type = 'purchase'").withColumn("value", F.col("value") * 2), "event_type", "purchase")


@query("SELECT event_id, event_type IS NOT TRUE AND flag IS NOT TRUE AS unmarked, l FROM (SELECT event_id, false AS event_type, CASE event_type WHEN 'error' THEN NULL WHEN 'click' THEN true ELSE false END AS flag, event_type AS l FROM events)")
def null_safe_mask(spark, sf):
    """Rows not marked, whether or not they have a mark."""
    flag = F.when(F.col("event_type") == "error", None).when(F.col("event_type") == "click", True).otherwise(False)
    return table(spark, sf, "events").select("event_id", (~F.coalesce(flag, F.lit(False))).alias("unmarked"), F.col("event_type").alias("l"))


@query("SELECT DISTINCT p_brand, kind FROM (SELECT p_brand, CASE WHEN p_size > 25 THEN p_type END AS kind FROM part) WHERE kind IS NOT NULL")
def distinct_values(spark, sf):
    """Distinct values without nulls."""
    return table(spark, sf, "part").select("p_brand", F.when(F.col("p_size") > 25, F.col("p_type")).alias("kind")).filter("kind is not null").distinct()


@query("SELECT l_orderkey, l_linenumber, l_shipdate, l_suppkey FROM lineitem")
def prefixed_columns(spark, sf):
    """Keys, and the columns of a prefix."""
    d = table(spark, sf, "lineitem")
    return d.select("l_orderkey", "l_linenumber", *(c for c in d.columns if c.startswith(("l_ship", "l_supp"))))


@query(f"WITH {GEO} SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'green' ELSE 'blue' END AS colour, round(1000 + (dz - 1000) * 2.5, 6)::DOUBLE AS tall, round(dx - 50, 6) AS right, round((dz - 1000) * 2.5, 6)::DOUBLE AS up, round(-(dy - 75), 6) + 0.0 AS back, epoch_us(TIMESTAMP '2024-01-01 00:00:00') + round(value * 1e6)::BIGINT AS us FROM p")
def display_scalars(spark, sf):
    """Palette, exaggerated heights, scene axes, relative seconds as timestamps."""
    right, up, back = s.scene_axes(F.col("dx"), F.col("dy"), F.col("dz"), (F.lit(50.0), F.lit(75.0), F.lit(1000.0)), 2.5)
    return geometry(spark, sf).select("event_id", s.colour(F.col("user_id"), ("red", "green", "blue")).alias("colour"), F.round(s.exaggerated(F.col("dz"), F.lit(1000.0), 2.5), 6).alias("tall"), F.round(right, 6).alias("right"), F.round(up, 6).alias("up"), (F.round(back, 6) + 0.0).alias("back"), F.unix_micros(s.at_epoch(F.col("value"), "2024-01-01 00:00:00")).alias("us"))


@query("SELECT event_type, label FROM (SELECT event_type, 'T' || user_id AS label, row_number() OVER (PARTITION BY event_type ORDER BY min(event_id)) AS n FROM events GROUP BY event_type, user_id) WHERE n <= 15")
def legend(spark, sf):
    """The first fifteen labels of each kind in the order they come."""
    d = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.min("event_id").alias("first"))
    rank = F.row_number().over(Window.partitionBy("event_type").orderBy("first"))
    return d.withColumn("n", rank).filter("n <= 15").select("event_type", F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("label"))


NEAREST = f"WITH {SIGNAL}, f AS (SELECT event_id AS id, user_id, floor(t / 86400) AS day, value FROM sig WHERE event_type <> 'purchase'), h AS (SELECT event_id AS gt, user_id, floor(t / 86400) AS day, value AS own FROM sig WHERE event_type = 'purchase') SELECT id, gt, round(abs(value - own), 6) AS distance FROM f JOIN h USING (user_id, day) QUALIFY row_number() OVER (PARTITION BY id ORDER BY abs(value - own), gt) = 1"


@query(NEAREST)
def nearest_truth(spark, sf):
    """Of each fused row the nearest truth of its frame."""
    d = signal(spark, sf).withColumn("day", F.floor(F.col("t") / 86400))
    fused, truth = d.filter("event_type <> 'purchase'"), d.filter("event_type = 'purchase'")
    return scoring.nearest_truth(fused.select("user_id", "day", F.col("event_id").alias("id"), "value"), truth.select("user_id", "day", F.col("event_id").alias("gt"), F.col("value").alias("own")), ["user_id", "day"], "id", "gt", F.abs(F.col("value") - F.col("own"))).withColumn("distance", F.round("distance", 6))
