"""Path derivation, readers of truth files, streamed bins and sessions."""

import pytest
from pyspark.sql import functions as F

from trackloom.functions import scalars as s
from trackloom.operators import generators as g
from trackloom.sources import files
from trackloom.streaming import fusion


def test_derived_path(spark):
    rows = [(100.0, 40.0, 30.0, 1000.0), (100.0, 40.0, 30.0, 1000.0), (110.0, 40.0, 30.01, 1100.0), (110.05, 40.5, 30.01, 1100.0), (130.05, 40.5, 30.01, 1120.0)]
    path = spark.createDataFrame(rows, "time_unix double, lat double, lon double, alt_m double")
    got = g.derive_path(path, "T", (40.0, 30.0)).orderBy("time").collect()
    assert [round(r.time, 2) for r in got] == [0.0, 10.0, 10.05, 30.05]
    assert got[0].x == 0 and got[0].y == 0 and got[1].x == pytest.approx(851.8, abs=1) and got[0].z == 1000
    # differences: 0, 100 m in 10 s, none, 20 m in 20 s; then means over three rows
    assert [r.vz for r in got] == pytest.approx([5.0, 10 / 3, 11 / 3, 0.5])
    # 55 km in 0.05 s count as 0.1 s and are clipped to 350 m/s
    assert got[2].vy == pytest.approx(350 / 3)


def test_truth_tables_under_one_key(spark):
    old = spark.createDataFrame([("A", 0.0, 1.0, 2.0, 3.0, 4.0)], "target string, time double, x double, y double, vx double, vy double")
    r = files.normalise_truth(old).first()
    assert (r.scenario, r.callsign, r.z, r.vz) == ("default", "A", 0.0, 0.0)


def test_streamed_bins_and_sessions(spark, tmp_path):
    rows = [(f"2024-01-01 00:00:{k:02d}", u) for k, u in ((1, "a"), (2, "a"), (9, "a"), (2, "b"))] + [("2024-01-01 01:00:00", "c")]
    events = spark.createDataFrame(rows, "at string, who string").withColumn("at", F.col("at").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    for name, make in (("bins", lambda d: fusion.detection_bins(d, "at", "who", "5 seconds")), ("gaps", lambda d: fusion.sessions(d, "at", "who", "5 seconds"))):
        stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
        run = make(stream).writeStream.outputMode("complete" if name == "bins" else "append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        run.awaitTermination()
    got = sorted((r.who, r["count"]) for r in spark.table("bins").collect())
    assert got == [("a", 1), ("a", 2), ("b", 1), ("c", 1)]
    # the last hour closes all sessions but its own
    assert sorted((r.who, r["count"]) for r in spark.table("gaps").collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_radar_classes(spark):
    names = ["RADAR_A", "sensor-b", "A_C-x", " rdrc ", "", None, "x_y", "a"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(s.radar_bucket(F.col("n")).alias("b")).collect()
    assert [r.b for r in got] == ["A", "B", "C", "C", "OTHER", "OTHER", "OTHER", "A"]
