import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import generators as g
from trackloom.operators import scoring, tracking
from trackloom.operators import timeseries as ts
from trackloom.plans import queries
from trackloom.sources import files, rest


def test_interpolation_equals_numpy(spark):
    rng = np.random.default_rng(0)
    t = np.sort(rng.random(40)) * 100
    v = rng.random(40)
    ask = rng.random(200) * 130 - 15
    left = spark.createDataFrame([(1, float(a)) for a in ask], "k int, t double")
    right = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(t, v)], "k int, t double, v double")
    got = {r.t: r.v for r in ts.interpolation_join(left, right, "k", "t", ["v"], edge="clamp").collect()}
    assert max(abs(got[a] - np.interp(a, t, v)) for a in ask) < 1e-12
    inside = {r.t: r.v for r in ts.interpolation_join(left, right, "k", "t", ["v"]).collect()}
    assert all((inside[a] is None) == (a < t[0] or a > t[-1]) for a in ask)


def test_gradient_and_unwrap(spark):
    t = np.cumsum(np.random.default_rng(1).random(20) + 0.1)
    v = np.sin(t)
    df = spark.createDataFrame([(1, float(a), float(b), float((a + np.pi) % (2 * np.pi) - np.pi)) for a, b in zip(t, v)], "k int, t double, v double, a double")
    w = ts.ordered("k", "t")
    got = df.select("t", ts.gradient("v", "t", w).alias("g"), ts.unwrap("a", w).alias("u")).orderBy("t").collect()
    assert np.allclose([r.g for r in got], np.gradient(v, t, edge_order=2))
    assert np.allclose(np.diff([r.u for r in got]), np.diff(t))


def test_explicit_timeline(spark):
    gt = spark.createDataFrame([("s", "T1", 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0), ("s", "T1", 2.0, 2.0, 0.0, 0.0, 1.0, 0.0, 0.0)], "scenario string, callsign string, time double, x double, y double, z double, vx double, vy double, vz double")
    row = {n: 0.0 for n in tracking.NAMES} | {"scenario": "s", "global_track_id": "G1"}
    fused = spark.createDataFrame([row], "scenario string, time double, global_track_id string, x double, y double, z double, vx double, vy double, vz double, " + ", ".join(f"{c} double" for c in (*scoring.SIGMAS, "pos_sigma_m", "vel_sigma_mps")))
    times = spark.createDataFrame([("s", float(t)) for t in range(3)], "scenario string, time double")
    for got in (scoring.tracking_metrics(fused, gt, times).first(), scoring.target_metrics(fused, gt, times).first()):
        assert (got.total_tp, got.total_fn) == (1, 2) and got.recall == pytest.approx(1 / 3)


def test_spiral(spark):
    p = g.Spiral(hz=2.0)
    r = g.spiral_route(spark, "s", "T5", p).orderBy("time").toPandas()
    assert abs(r.z.iloc[-1] - 4880) < 15
    assert abs(r.speed.iloc[2:-2].mean() - 77) < 0.2
    assert abs(r.spiral_theta_rad.iloc[-1] / (2 * np.pi) - 4) < 0.01
    assert r.spiral_radius_m.iloc[0] == pytest.approx(500)
    with pytest.raises(ValueError):
        g.Spiral(speed=-1)


def test_simulation_is_reproducible_and_tracks(spark):
    gt = queries.truth(spark, seconds=120.0)
    sensor = g.simulate(gt).persist()
    assert ts.same_rows(sensor, g.simulate(gt.repartition(3)))
    fused = tracking.fuse(sensor, "imm").persist()
    got = scoring.tracking_metrics(fused, gt).first()
    assert got.precision > 0.5 and got.recall > 0.3 and got.rmse_pos_m < 400


def test_sources(spark, tmp_path):
    path = str(tmp_path / "a.csv")
    spark.createDataFrame([(0.0, 1.0, "T"), (1.0, None, "T")], "time double, x double, callsign string").coalesce(1).write.option("header", True).csv(path)
    got = files.read_csv(spark, path, files.GROUND_TRUTH)
    assert got.count() == 2 and got.filter("x is null").count() == 1 and "lat" in got.columns
    assert files.read_csv_or_empty(spark, str(tmp_path / "none"), files.GROUND_TRUTH).count() == 0
    with pytest.raises(ValueError, match="nulls"):
        files.validate(got, ["time", "x"], "truth")
    odd = spark.createDataFrame([("1,5", " 2 ", "T")], "T string, pos_x string, Target string")
    assert tuple(files.with_aliases(odd).first()) == (1.5, 2.0, None, None, "T")


def test_rest_rows_and_token():
    calls = []

    def fetch(url, form):
        calls.append(url)
        return 200, '{"access_token": "a", "expires_in": 100}'

    clock = [0.0]
    token = rest.Token("u", "i", "s", fetch, lambda: clock[0])
    assert token.get() == token.get() == "a" and len(calls) == 1
    clock[0] = 50.0
    token.get()
    assert len(calls) == 2
    assert rest.checked(404, "") == {}
    with pytest.raises(ConnectionError):
        rest.checked(429, "")
    assert list(rest.path_rows({"callsign": " ab1 ", "path": [[1, 2.0, 3.0, None], [2, None, 1, 1]]}, "x")) == [("x", "AB1", 1.0, 2.0, 3.0, 0.0)]


def test_stream_equals_batch(spark, tmp_path):
    from trackloom.streaming.fusion import fuse_stream

    sensor = g.simulate(queries.truth(spark, seconds=60.0)).withColumn("ts", F.timestamp_seconds("time"))
    far = sensor.limit(1).withColumns({"time": F.lit(99999.0), "ts": F.timestamp_seconds(F.lit(99999.0)), "scenario": F.lit("end")})
    folder = str(tmp_path / "in")
    for k, part in enumerate((sensor.filter("time < 30"), sensor.filter("time >= 30"), far)):
        part.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(sensor.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = fuse_stream(stream, "imm", "200 seconds").writeStream.format("memory").queryName("fused").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    key = lambda rows: sorted((r.time, r.global_track_id, round(r.x, 6)) for r in rows)
    got, want = key(spark.table("fused").filter("scenario = 'demo'").collect()), key(tracking.fuse(sensor, "imm").collect())
    assert got == want


def test_one_sort_finds_both_neighbours(spark):
    """Neighbours on both sides come from one order, with several samples at one time and rows without a time."""
    rows = spark.createDataFrame([("k", t) for t in (None, 0.0, 1.0, 1.5, 2.0, 3.0, 9.0)], "k string, t double")
    have = spark.createDataFrame([("k", 1.0, 5.0), ("k", 1.0, 7.0), ("k", 3.0, 1.0), ("k", 3.0, 11.0), ("k", 4.0, 0.0)], "k string, t double, v double")
    found = ts.interpolation_join(rows, have, "k", "t", ["v"], edge="clamp")
    assert {r.t: r.v for r in found.collect()} == {None: None, 0.0: 7.0, 1.0: 7.0, 1.5: 8.0, 2.0: 9.0, 3.0: 11.0, 9.0: 0.0}
    near = {r.t: (r.matched_time, r.v) for r in ts.nearest_join(rows, have, "k", "t", ["v"]).collect()}
    assert near[2.0] == (1.0, 7.0) and near[3.0] == (3.0, 11.0) and near[None] == (None, None)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = ts.interpolation_join(rows, have, "k", "t", ["v"], edge="clamp")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum("Sort [" in line for line in plan.splitlines()) == 1
