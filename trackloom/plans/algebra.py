"""Registered queries of array algebra and of paths, with DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import arrays as m
from trackloom.operators import paths
from trackloom.plans.kinematics import GEO, STEP, geometry, steps
from trackloom.plans.queries import query, table


@query("""SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dot, round(sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])), 6) AS norm,
 round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS cosine
 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - a.vec_id % 20""")
def embedding_dot(spark, sf):
    """J: products, lengths and cosines of arrays."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    pair = e.withColumn("head", F.col("vec_id") - F.col("vec_id") % 20).join(e.select(F.col("vec_id").alias("head"), F.col("embedding").alias("other")), "head")
    return pair.select("vec_id", F.round(m.dot("embedding", "other"), 6).alias("dot"), F.round(m.norm("embedding"), 6).alias("norm"), F.round(m.cosine("embedding", "other"), 6).alias("cosine"))


# covariances diag(900, 2500, 400) plus the outer product of a step's velocities, over a hundred
COV = f"{STEP}, c AS (SELECT event_id, ex / 10 AS x, ey / 10 AS y, ez / 10 AS z, fx / 10 AS u, fy / 10 AS v, fz / 10 AS w FROM e), m AS (SELECT *, 900 + u * u AS a, u * v AS b, u * w AS c, 2500 + v * v AS d, v * w AS e, 400 + w * w AS f FROM c), k AS (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det, a * d - b * b AS det2 FROM m)"


@query(f"""WITH {COV} SELECT event_id, round(ln(det), 9) AS log_det, round(a * x * x + d * y * y + f * z * z + 2 * (b * x * y + c * x * z + e * y * z), 3) AS form,
 round(((d * f - e * e) * x * x + (a * f - c * c) * y * y + (a * d - b * b) * z * z + 2 * ((c * e - b * f) * x * y + (b * e - c * d) * x * z + (b * c - a * e) * y * z)) / det, 6) AS d3,
 round((d * x * x - 2 * b * x * y + a * y * y) / det2, 6) AS d2, round(-0.5 * ((d * x * x - 2 * b * x * y + a * y * y) / det2 + ln(det2) + 2 * ln(2 * pi())), 6) AS likelihood FROM k""")
def full_covariances(spark, sf):
    """J3 beyond diagonals: quadratic forms, inverses, log-determinants and likelihoods of 2 x 2 and 3 x 3 covariances."""
    d = steps(spark, sf).withColumns({"x": F.array(*(F.col(c) / 10 for c in ("ex", "ey", "ez"))), "v": F.array(*(F.col(c) / 10 for c in ("fx", "fy", "fz")))})
    d = d.withColumn("p", m.plus(m.diagonal(F.lit(900.0), F.lit(2500.0), F.lit(400.0)), m.outer(F.col("v"), F.col("v"))))
    d = d.withColumns({"q": F.transform(F.slice("p", 1, 2), lambda row: F.slice(row, 1, 2)), "y": F.slice("x", 1, 2)})
    p, q, x, y = (F.col(c) for c in "pqxy")
    return d.select("event_id", F.round(m.log_determinant(p, 3), 9).alias("log_det"), F.round(m.quadratic_form(p, x), 3).alias("form"), F.round(m.mahalanobis(p, x, 3), 6).alias("d3"), F.round(m.mahalanobis(q, y, 2), 6).alias("d2"), F.round(m.log_likelihood(q, y, 2), 6).alias("likelihood"))


@query(f"WITH {GEO}, v AS (SELECT event_id, [0.7, 0.2, 0.1] AS p, [-dx * dx / 1e7, -dy * dy / 1e6, -dz * dz / 1e7] AS l FROM p), j AS (SELECT event_id, list_transform(range(1, 4), lambda i: ln(p[i]::DOUBLE) + l[i]) AS j FROM v), s AS (SELECT *, list_max(j) + ln(list_sum(list_transform(j, lambda x: exp(x - list_max(j))))) AS total FROM j) SELECT event_id, round(total, 9) AS total, round(exp(j[1] - total), 9) AS first, round(exp(j[2] - total), 9) AS second, round(exp(j[3] - total), 9) AS third FROM s")
def mode_posterior(spark, sf):
    """J: probabilities of modes from log-likelihoods, scaled by the largest."""
    d = geometry(spark, sf).select("event_id", F.array(F.lit(0.7), F.lit(0.2), F.lit(0.1)).alias("p"), F.array(-F.col("dx") * F.col("dx") / 1e7, -F.col("dy") * F.col("dy") / 1e6, -F.col("dz") * F.col("dz") / 1e7).alias("l"))
    d = d.withColumns({"q": m.posterior(F.col("p"), F.col("l")), "total": m.log_sum_exp(F.zip_with("p", "l", lambda p, x: F.ln(p) + x))})
    return d.select("event_id", F.round("total", 9).alias("total"), *(F.round(F.get("q", F.lit(k)), 9).alias(n) for k, n in enumerate(("first", "second", "third"))))


SEGMENTS = f"{GEO}, s AS (SELECT user_id // 10 AS scenario, user_id, t AS t0, dx AS x0, dy AS y0, dz AS z0, lead(t) OVER w AS t1, lead(dx) OVER w AS x1, lead(dy) OVER w AS y1, lead(dz) OVER w AS z1 FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t, dx, dy, dz)), o AS (SELECT a.scenario, a.user_id AS a, b.user_id AS b, greatest(a.t0, b.t0) AS lo, least(a.t1, b.t1) AS hi, " + ", ".join(
    f"(b.{c}1 - b.{c}0) / (b.t1 - b.t0) - (a.{c}1 - a.{c}0) / (a.t1 - a.t0) AS v{c}, b.{c}0 + (b.{c}1 - b.{c}0) / (b.t1 - b.t0) * (greatest(a.t0, b.t0) - b.t0) - a.{c}0 - (a.{c}1 - a.{c}0) / (a.t1 - a.t0) * (greatest(a.t0, b.t0) - a.t0) AS r{c}" for c in "xyz"
) + " FROM s a JOIN s b ON a.scenario = b.scenario AND a.user_id < b.user_id AND a.t0 <= b.t1 AND b.t0 <= a.t1 AND a.t1 > a.t0 AND b.t1 > b.t0), u AS (SELECT *, greatest(0, least(hi - lo, coalesce(-(rx * vx + ry * vy + rz * vz) / nullif(vx * vx + vy * vy + vz * vz, 0), 0))) AS turn FROM o)"


@query(f"WITH {SEGMENTS} SELECT scenario::BIGINT AS scenario, a, b, round(min(sqrt(pow(rx + vx * turn, 2) + pow(ry + vy * turn, 2) + pow(rz + vz * turn, 2))), 3) AS distance FROM u GROUP BY ALL")
def closest_approach(spark, sf):
    """Least distance of every two users of a scenario, straight between their events."""
    d = geometry(spark, sf).select(F.floor(F.col("user_id") / 10).alias("scenario"), "user_id", "t", F.col("dx").alias("x"), F.col("dy").alias("y"), F.col("dz").alias("z"))
    return paths.closest_approach(d, ["scenario"], "user_id", "t", 86400.0).withColumn("distance", F.round("distance", 3))


STEP_M = 2500.0
ARC = f"{GEO}, d AS (SELECT user_id, event_id, t, dx, dy, dz, lag(t) OVER w AS pt, lag(dx) OVER w AS px, lag(dy) OVER w AS py, lag(dz) OVER w AS pz FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)), l AS (SELECT *, coalesce(sqrt(pow(dx - px, 2) + pow(dy - py, 2) + pow(dz - pz, 2)), 0) AS len FROM d), c AS (SELECT *, sum(len) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS b FROM l), f AS (SELECT *, lag(b) OVER (PARTITION BY user_id ORDER BY t, event_id) AS a FROM c), g2 AS (SELECT *, unnest(range(CASE WHEN a IS NULL THEN 0 ELSE floor(a / 2500)::BIGINT + 1 END, floor(b / 2500)::BIGINT + 1)) AS point FROM f)"


@query(f"WITH {ARC} SELECT user_id, point, point * 2500.0::DOUBLE AS arc, " + ", ".join(f"round(CASE WHEN a IS NULL THEN {c} ELSE {p} + (point * 2500.0 - a) / (b - a) * ({c} - {p}) END, {n}) AS {o}" for c, p, o, n in (("dx", "px", "x", 4), ("dy", "py", "y", 4), ("dz", "pz", "z", 4), ("t", "pt", "t", 1))) + " FROM g2")
def arc_resampling(spark, sf):
    """Each user's path at equal steps of arc length."""
    d = geometry(spark, sf).select("user_id", "event_id", F.col("dx").alias("x"), F.col("dy").alias("y"), F.col("dz").alias("z"), "t")
    found = paths.resample_by_arc(d, "user_id", ["t", "event_id"], ["t"], STEP_M)
    return found.select("user_id", "point", "arc", *(F.round(c, 4).alias(c) for c in "xyz"), F.round("t", 1).alias("t"))
