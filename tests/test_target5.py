"""Adding a target to a scenario: its measurements, their alignment, the update in place."""

import pytest
from pyspark.sql import functions as F

from trackloom.operators import generators as g
from trackloom.operators import timeseries as ts
from trackloom.plans import queries
from trackloom.sources import files


@pytest.fixture(scope="module")
def base(spark):
    return g.simulate(queries.truth(spark, seconds=60.0)).persist()


@pytest.fixture(scope="module")
def fifth(spark):
    return g.spiral_route(spark, "demo", "T5", g.Spiral(hz=1.0, turns=1.0)).filter("time <= 60").persist()


def test_measurements_scale_about_the_truth(fifth):
    key = ["sensor", "local_track_id", "time"]
    one = g.target_measurements(fifth, seed=7).persist()
    assert one.count() > 10 and set(r.callsign_true for r in one.collect()) == {"T5"}
    assert ts.same_rows(one, g.target_measurements(fifth, seed=7)) and not ts.same_rows(one, g.target_measurements(fifth, seed=8))
    tiny = g.target_measurements(fifth, seed=7, noise_scale=1e-9)
    both = one.join(tiny.select(*key, F.col("x").alias("true_x"), F.col("sigma_pos_m").alias("small")), key)
    twice = g.target_measurements(fifth, seed=7, noise_scale=2.0).select(*key, F.col("x").alias("far_x"))
    row = both.join(twice, key).agg(F.count("*"), F.max(F.abs(F.col("far_x") - F.col("true_x") - 2 * (F.col("x") - F.col("true_x")))), F.max(F.abs(F.col("small") - 1e-9 * F.col("sigma_pos_m")))).first()
    assert row[0] == one.count() and row[1] < 1e-3 and row[2] < 1e-6
    assert g.target_measurements(fifth, detection_probability=0.0).isEmpty()
    with pytest.raises(ValueError):
        g.target_measurements(fifth, noise_scale=0.0)
    with pytest.raises(ValueError):
        g.target_measurements(fifth, detection_probability=1.5)


def test_alignment_keeps_the_other_rows(base, fifth):
    own = g.target_measurements(fifth, tuple(g.RADARS))
    got = g.add_target(base, own, "T5").persist()
    assert ts.same_rows(got.filter("callsign_true <> 'T5'"), base)
    scans = {(r.sensor, r.time) for r in base.select("sensor", "time").collect()}
    added = got.filter("callsign_true = 'T5'").collect()
    assert added and all((r.sensor, r.time) in scans for r in added) and len({(r.sensor, r.time) for r in added}) == len(added)
    again = g.add_target(got, own, "T5")
    assert ts.same_rows(again, got)


def test_update_in_place(spark, base, fifth, tmp_path):
    path = str(tmp_path / "sensor")
    base.write.parquet(path)
    own = g.target_measurements(fifth, tuple(g.RADARS))
    merge = lambda old, new, key, value: g.add_target(old, new, value)
    got = files.update_in_place(spark, path, own, "callsign_true", "T5", merge)
    assert got.filter("callsign_true = 'T5'").count() > 0 and ts.same_rows(got.filter("callsign_true <> 'T5'"), base)
    before = spark.read.parquet(path).count()
    with pytest.raises(ValueError):
        files.update_in_place(spark, path, own, "callsign_true", "T5", lambda old, new, key, value: old.withColumn("x", F.col("x") + 1))
    assert spark.read.parquet(path).count() == before and not (tmp_path / "sensor__staged").exists()


def test_scenario_files(spark, fifth, tmp_path):
    files.write_scenario({"gt": fifth}, str(tmp_path / "a"), window=(10.0, 20.0))
    cut = spark.read.parquet(str(tmp_path / "a/gt"))
    assert cut.agg(F.min("time"), F.max("time")).first() == (10.0, 20.0) and "spiral_radius_m" in cut.columns
    files.write_scenario({"gt": fifth}, str(tmp_path / "b"), fmt="csv")
    whole = spark.read.option("header", True).csv(str(tmp_path / "b/gt"))
    assert whole.count() == fifth.count() and not [c for c in whole.columns if c.startswith("spiral_")]
