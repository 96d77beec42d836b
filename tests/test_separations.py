"""Least distances of candidate spirals: each target is asked for once at a time, for all candidates."""

from pyspark.sql import functions as F

from trackloom.operators import generators as g


def test_distances_of_all_candidates_in_one_pass(spark, monkeypatch):
    gt = spark.createDataFrame([(f"s{s}", f"T{j}", float(t), 90.0 * j + 40 * t * j, 700.0 * s - 60000.0 * (j == 2), 3000.0, 0.0, 0.0, 0.0) for s in range(3) for j in range(3) for t in (0, 40, 90)], "scenario string, callsign string, time double, x double, y double, z double, vx double, vy double, vz double")
    centres, p = gt.groupBy("scenario").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy")), g.Spiral(hz=0.2)
    asked, join = [], g.interpolation_join
    monkeypatch.setattr(g, "interpolation_join", lambda left, *a, **k: (asked.append(left), join(left, *a, **k))[1])
    got = {(r.scenario, r.callsign): r.min_distance for r in g.spiral_separations(centres, gt, p, 1000.0).collect()}
    once = sum(d.count() for d in asked if "at" in d.columns)
    assert once == 9 * g.spiral_route(spark, "", "T5", p).count()
    # alone: every candidate's path against every target, the first candidate that is far enough of all
    want = {}
    for c in centres.collect():
        own = gt.filter(F.col("scenario") == c.scenario)
        for spec in g.candidate_spirals(g.Spiral(hz=0.2, centre=(c.cx, c.cy))):
            near = {r.callsign: r.min_distance for r in g.separations(g.spiral_route(spark, c.scenario, "T5", spec), own).collect()}
            if min(near.values()) >= 1000.0:
                want |= {(c.scenario, k): v for k, v in near.items()}
                break
    assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    route = g.spirals(centres, "T5", p, 1000.0, gt)
    same = {(r.scenario, r.callsign): r.min_distance for r in g.separations(route, gt, ("scenario",)).collect()}
    assert same.keys() == want.keys() and all(abs(same[k] - want[k]) < 1e-6 for k in want)
