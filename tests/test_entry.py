import __spark_entry__ as entry
from trackloom.operators import generators as g
from trackloom.plans import api, queries


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_file_round_trip_and_diagnosis(spark, tmp_path):
    sensor = g.simulate(queries.truth(spark, seconds=60.0)).persist()
    path = str(tmp_path / "sensor")
    sensor.drop("scenario", "ord").coalesce(1).write.option("header", True).csv(path)
    fused = api.run_fusion(spark, path, str(tmp_path / "out"), "advanced")
    assert set(fused.columns) >= {"time", "global_track_id", "x", "prob"}
    events = api.diagnose(sensor)
    assert events.count() == sensor.count()
    total = api.diagnosis_summary(events).selectExpr("sum(n) as n", "sum(source_map + hungarian + revive + create) as s").first()
    assert total.n == total.s == sensor.count()
