"""Paths of moving keys: closest approach of two, points at equal steps of arc length."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import scalars as s
from trackloom.operators.timeseries import rolling_mean

AXES = ("x", "y", "z")


def _segments(df: DataFrame, within: list[str], key: str, time: str) -> DataFrame:
    """``within, key, t0, t1, p0, p1``: straight stretches between a key's samples, of two times the earlier first."""
    w = Window.partitionBy(*within, key).orderBy(time, *AXES)
    rows = df.select(*within, key, F.col(time).alias("t0"), F.array(*(F.col(c).cast("double") for c in AXES)).alias("p0"), F.lead(time).over(w).alias("t1"), F.lead(F.array(*(F.col(c).cast("double") for c in AXES))).over(w).alias("p1"))
    return rows.filter("t1 > t0")


def closest_approach(df: DataFrame, within: list[str], key: str, time: str, bucket: float) -> DataFrame:
    """``within, a, b, distance``: for every two keys (a < b) that share a time, the least distance of their paths, straight
    between samples. In the time that two stretches share the relative motion is straight, so the least distance is where
    it turns or at an end.

    Stretches meet in the time ``bucket``s that they cross, as wide as a few samples; within a bucket all keys of ``within``
    meet, as every two of them are asked for.
    """
    pieces = _segments(df, within, key, time).withColumn("k", F.explode(F.sequence(F.floor(F.col("t0") / bucket), F.floor(F.col("t1") / bucket))))
    a, b = pieces.alias("a"), pieces.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*within, "k"]] + [F.col(f"a.{key}") < F.col(f"b.{key}")]
    pairs = a.join(b, on).withColumns({"lo": F.greatest("a.t0", "b.t0", F.col("a.k") * bucket), "hi": F.least("a.t1", "b.t1", (F.col("a.k") + 1) * bucket)}).filter("lo <= hi")

    def motion(s: str, i: int):
        """Speed, and place at ``lo``, of a stretch along an axis."""
        p0, p1, t0 = F.get(f"{s}.p0", F.lit(i)), F.get(f"{s}.p1", F.lit(i)), F.col(f"{s}.t0")
        speed = (p1 - p0) / (F.col(f"{s}.t1") - t0)
        return speed, p0 + speed * (F.col("lo") - t0)

    axes = [(motion("a", i), motion("b", i)) for i in range(3)]
    off = pairs.select(*(F.col(f"a.{c}") for c in within), F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"), (F.col("hi") - F.col("lo")).alias("span"), *((q[1] - p[1]).alias(f"r{i}") for i, (p, q) in enumerate(axes)), *((q[0] - p[0]).alias(f"v{i}") for i, (p, q) in enumerate(axes)))
    total = lambda x, y: sum((F.col(f"{x}{i}") * F.col(f"{y}{i}") for i in (1, 2)), F.col(f"{x}0") * F.col(f"{y}0"))
    at = F.greatest(F.lit(0.0), F.least("span", F.coalesce(F.try_divide(-total("r", "v"), total("v", "v")), F.lit(0.0))))
    off = off.withColumn("at", at)
    d = F.sqrt(sum((F.pow(F.col(f"r{i}") + F.col(f"v{i}") * F.col("at"), 2) for i in (1, 2)), F.pow(F.col("r0") + F.col("v0") * F.col("at"), 2)))
    return off.groupBy(*within, "a", "b").agg(F.min(d).alias("distance"))


def resample_by_arc(df: DataFrame, key: str, order: list[str], values: list[str], step: float) -> DataFrame:
    """``key, point, arc, x, y, z, values``: points at multiples of ``step`` of each key's arc length, from its first row on,
    linear in the arc between rows. A row without a place is passed over. A key's rows are summed in one order."""
    held = df.filter(" and ".join(f"{c} is not null and not isnan({c})" for c in AXES))
    w = Window.partitionBy(key).orderBy(*order)
    sides = [*AXES, *values]
    held = held.withColumns({f"__{c}": F.lag(c).over(w) for c in sides})
    length = F.sqrt(sum((F.pow(F.col(c) - F.col(f"__{c}"), 2) for c in AXES[1:]), F.pow(F.col("x") - F.col("__x"), 2)))
    held = held.withColumn("__d", F.coalesce(length, F.lit(0.0)))
    held = held.withColumn("__to", F.sum("__d").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__from", F.coalesce(F.lag("__to").over(w), F.lit(-1.0)))
    # multiples in (from, to]; the first row has the multiple 0
    lo, hi = F.floor(F.greatest("__from", F.lit(-step)) / step) + 1, F.floor(F.col("__to") / step)
    first = F.when(F.col("__from") < 0, F.lit(0)).otherwise(lo)
    points = held.filter(first <= hi).withColumn("point", F.explode(F.sequence(first, hi)))
    share = F.when(F.col("__d") > 0, (F.col("point") * step - F.col("__from")) / (F.col("__to") - F.col("__from"))).otherwise(1.0)
    between = lambda c: F.when(F.col(f"__{c}").isNull(), F.col(c)).otherwise(F.col(f"__{c}") + share * (F.col(c) - F.col(f"__{c}")))
    return points.select(key, "point", (F.col("point") * step).alias("arc"), *(between(c).alias(c) for c in sides))


def truth_of_paths(points: DataFrame, key: str, least: int = 5) -> DataFrame:
    """``key, time, x, y, z, vx, vy, vz`` from points (``time_unix, lat, lon, alt_m``) of any number of paths, each in local metres
    about its medians and in seconds from its first point.

    Points without a position are left out, of several at one time one stays, a missing height is 0; a path of fewer than
    ``least`` points is left out. Velocities are differences over 0.1 s at least, cut at 350 m/s and smoothed over three rows.
    """
    placed = points.filter("lat is not null and lon is not null").withColumn("alt_m", F.coalesce("alt_m", F.lit(0.0)))
    enough = F.count("*").over(Window.partitionBy(key)) >= least
    first = placed.withColumn("__enough", enough).filter("__enough").groupBy(key, "time_unix").agg(F.min(F.struct("lat", "lon", "alt_m")).alias("p")).select(key, "time_unix", "p.*")
    about = first.groupBy(key).agg(F.median("lat").alias("__lat"), F.median("lon").alias("__lon"), F.median("alt_m").alias("__alt"), F.min("time_unix").alias("__t0"))
    d = first.join(about, key).withColumns({"time": F.col("time_unix") - F.col("__t0"), "x": s.enu_x(F.col("lon"), F.col("__lat"), F.col("__lon")), "y": s.enu_y(F.col("lat"), F.col("__lat")), "z": F.col("alt_m") - F.col("__alt")})
    w = Window.partitionBy(key).orderBy("time_unix")
    dt = F.greatest(F.coalesce(F.col("time") - F.lag("time").over(w), F.lit(1.0)), F.lit(0.1))
    d = d.withColumns({f"v{c}": s.clip(F.coalesce((F.col(c) - F.lag(c).over(w)) / dt, F.lit(0.0)), -350.0, 350.0) for c in AXES})
    d = d.withColumns({f"v{c}": rolling_mean(f"v{c}", w) for c in AXES})
    return d.select(key, "time", *AXES, *(f"v{c}" for c in AXES), "lat", "lon", "alt_m", "time_unix")
