from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from trackloom.operators import generators as g
from trackloom.operators import timeseries as ts
from trackloom.plans import queries


def test_realistic_radars_see_targets_ghosts_and_points(spark):
    gt = queries.truth(spark)
    seen = [replace(r, visible=0.5) for r in g.REALISTIC]
    got = g.simulate_realistic(gt, tuple(seen)).persist()
    kinds = {r.callsign_true for r in got.select("callsign_true").distinct().collect()}
    assert {"T1", "T2", "T3", "GHOST_TRACK"} <= kinds and any(k.startswith("STATIC_CLUTTER_") for k in kinds)
    assert got.filter("is_clutter <> (callsign_true not like 'T_')").isEmpty()
    ghosts = got.filter("callsign_true = 'GHOST_TRACK'").agg(F.min("time"), F.max("time"), F.min("track_quality"), F.max("track_quality")).first()
    assert 50 <= ghosts[0] and ghosts[1] <= 91.5 and 2 <= ghosts[2] <= ghosts[3] <= 5
    still = got.filter("callsign_true like 'STATIC%'").select("local_track_id", "sensor").distinct()
    assert still.count() == still.select("sensor").distinct().count()
    assert ts.same_rows(got, g.simulate_realistic(gt.repartition(3), tuple(seen)))


def test_noise_is_polar_and_bias_is_added(spark):
    gt = g.line_route(spark, "s", "T", (100_000.0, 0.0, 3000.0), (0.0, 100.0, 0.0), 2000.0)
    one = replace(g.REALISTIC[0], pd=1.0, pd_range=1e6, drift=0.0, latency=0.0, bias=(0.0, 0.0, 500.0))
    got = g.simulate_realistic(gt, (one,), static=0, ghosts=0).filter("callsign_true = 'T'").withColumns({"e": F.col("y") - 100 * F.col("time"), "u": F.col("z") - 3000})
    s = got.agg(F.count("*"), F.avg("u"), F.avg("vy")).first()
    assert s[0] > 700 and abs(s[1] - 500) < 20 and abs(s[2] - 100) < 2
    # the far end of the route turns and loses no quality: there is no manoeuvre on a line
    assert got.agg(F.min("track_quality")).first()[0] >= 12
    turning = gt.withColumn("vx", F.when(F.floor("time") % 2 == 0, 20.0).otherwise(0.0))
    assert g.simulate_realistic(turning, (one,), static=0, ghosts=0).filter("callsign_true = 'T'").agg(F.min("track_quality")).first()[0] < 12


def test_spiral_moves_away_from_a_target(spark):
    p = g.Spiral(hz=0.5)
    block = g.spiral_route(spark, "s", "X", p).select("callsign", "time", "x", "y", "z")
    route = g.separated_spiral(spark, "s", "T5", block, p)
    assert route.agg(F.avg("x")).first()[0] > 140_000
    with pytest.raises(ValueError):
        g.separated_spiral(spark, "s", "T5", block, p, least=1e6)


def test_fixed_rate_radars(spark):
    gt = g.line_route(spark, "s", "T", (50_000.0, 20_000.0, 3000.0), (100.0, 0.0, 0.0), 1000.0)
    one = g.FixedRadar("R", 2.5, 0.3, 0.8, 80.0, 2.0, 0.05, 0.5)
    got = g.simulate_fixed_rate(gt, (one,)).persist()
    real = got.filter("not is_clutter")
    assert 0.75 < real.count() / 401 < 0.85 and real.filter("time % 2.5 <> 0 or round(arrival_time - time, 3) <> 0.3").isEmpty()
    along = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2) - F.sqrt((50_000 + 100 * F.col("time")) ** 2 + 20_000.0**2 + 3000.0**2)
    mean, spread, wobble = real.agg(F.avg(along), F.stddev(along), F.stddev(F.col("vx") - 100)).first()
    assert abs(mean) < 20 and 65 < spread < 95 and 1.6 < wobble < 2.4
    false = got.filter("is_clutter")
    assert 150 < false.count() < 260 and false.filter("x < 50000 or x > 150000 or callsign_true <> 'CLUTTER'").isEmpty()
    assert ts.same_rows(got, g.simulate_fixed_rate(gt.repartition(3), (one,)))


def test_plain_radars_with_bias_and_the_sigmas_of_quality(spark):
    gt = g.line_route(spark, "s", "T", (50_000.0, 20_000.0, 3000.0), (100.0, 0.0, 0.0), 3000.0)
    one = replace(g.REALISTIC[0], realistic=False, pd=1.0, latency=0.0, bias=(500.0, -300.0, 100.0))
    got = g.simulate(gt, (one,)).filter("not is_clutter").persist()
    quality = {r.track_quality for r in got.select("track_quality").distinct().collect()}
    assert quality == {12, 13, 14}  # 13, one up or down, and no manoeuvre
    assert got.filter(F.abs(F.col("sigma_pos_m") - 1500 * F.pow(F.lit(30 / 1500), (F.col("track_quality") - 1) / 14)) > 1e-6).isEmpty()
    x, y, z = got.agg(F.avg(F.col("x") - 50_000 - 100 * F.col("time")), F.avg(F.col("y") - 20_000), F.avg(F.col("z") - 3000)).first()
    assert abs(x - 500) < 12 and abs(y + 300) < 12 and abs(z - 100) < 12


def test_spirals_of_many_scenarios(spark):
    """Each scenario's choice is what it would be alone; one in which nothing is free has none."""
    p = g.Spiral(hz=0.2)
    points = lambda name, x: [(name, "B", t, x, 0.0, 3000.0) for t in (0.0, 500.0)]
    rows = points("far", 40_000.0) + points("near", 900.0) + points("other", -49_000.0)
    rows += [("none", f"B{k}", t, x, y, z) for k, (x, y, z) in enumerate([(0.0, 0.0, 4000.0), (5e4, 0.0, 4000.0), (-5e4, 0.0, 4000.0), (0.0, 5e4, 4000.0), (0.0, -5e4, 4000.0)]) for t in (0.0, 500.0)]
    others = spark.createDataFrame(rows, "scenario string, callsign string, time double, x double, y double, z double")
    centres = spark.createDataFrame([(s, 0.0, 0.0) for s in ("far", "near", "other", "none")], "scenario string, cx double, cy double")
    got = g.spirals(centres, "T5", p, 3500.0, others)
    middle = {r.scenario: (r.x, r.y) for r in got.groupBy("scenario").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).collect()}
    assert set(middle) == {"far", "near", "other"}
    assert abs(middle["far"][0]) < 2000 and middle["near"][0] > 45_000 and abs(middle["other"][0]) < 2000
    alone = g.separated_spiral(spark, "near", "T5", others.filter("scenario = 'near'"), g.Spiral(hz=0.2, centre=(0.0, 0.0)), 3500.0)
    assert g.separations(got.filter("scenario = 'near'"), others.filter("scenario = 'near'")).collect() == g.separations(alone, others.filter("scenario = 'near'")).collect()


def test_spirals_of_many_scenarios_are_made_in_many_tasks(spark):
    """The centres are a few small rows that Spark puts in one task; what is made of them must not be."""
    p = g.Spiral(hz=2.0)
    rows = spark.range(4000).select(F.floor(F.col("id") / 4).cast("string").alias("scenario"), F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y"))
    got = g.spirals(queries.centres(rows), "T5", p)
    made = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(made) == 1000 * p.points() > 2 * g.MADE and max(made) <= g.MADE + p.points()
    ends = got.groupBy("scenario").agg(F.count("*").alias("n"), F.count_distinct("time").alias("times"), F.min_by("x", "time").alias("x")).filter(F.abs(F.col("x") - (4 * F.col("scenario").cast("double") + 1.5) - 500) < 1e-6)
    assert ends.filter((F.col("n") == p.points()) & (F.col("times") == p.points())).count() == 1000
