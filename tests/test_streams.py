"""Streams that end: equal to batch, in any order of rows within the delay, and going on after a stop."""

import random

from pyspark.sql import functions as F

from trackloom.streaming import runs

ROW = "who string, ts timestamp_ltz, value double"
GAP = 10.0


def plain(rows):
    out = {}
    for who, t, v in sorted(rows):
        own = out.setdefault(who, [])
        if own and t - own[-1][1] <= GAP:
            own[-1][1], own[-1][2], own[-1][3] = t, own[-1][2] + 1, own[-1][3] + v
        else:
            own.append([t, t, 1, v])
    return sorted((who, *map(int, s[:3]), s[3]) for who, own in out.items() for s in own)


def write(spark, rows, path):
    df = spark.createDataFrame([(w, float(t), v) for w, t, v in rows], "who string, t double, value double")
    df.select("who", F.timestamp_micros((F.col("t") * 1e6).cast("long")).alias("ts"), "value").coalesce(1).write.mode("append").parquet(path)


def read(spark, path):
    return spark.readStream.schema("who string, ts timestamp, value double").parquet(path)


def found(df):
    return sorted((r.key, r.start_us // 10**6, r.last_us // 10**6, r.n, r.total) for r in df.collect())


def test_sessions_go_on_after_a_stop(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), rng.randint(0, 400), float(k)) for k in range(150)]
    early, rest = [r for r in rows if r[1] < 200], [r for r in rows if r[1] >= 200]
    rng.shuffle(early)
    path, at = str(tmp_path / "in"), str(tmp_path / "run")
    write(spark, early, path)
    first, late = runs.run_sessions(read(spark, path), at, "who", "ts", "value", GAP)
    assert found(first) == plain(early) and late == 0
    assert first.filter("not ended").count() > 0 and first.filter("ended").count() > 0
    write(spark, rest, path)
    again, late = runs.run_sessions(read(spark, path), at, "who", "ts", "value", GAP, "30 seconds")
    assert found(again) == plain(rows) and late == 0


def test_late_rows_are_counted(spark, tmp_path):
    path, at = str(tmp_path / "in"), str(tmp_path / "run")
    write(spark, [("a", 100, 1.0), ("a", 500, 1.0)], path)
    runs.run_sessions(read(spark, path), at, "who", "ts", "value", GAP)
    write(spark, [("a", 120, 1.0), ("a", 505, 2.0)], path)
    got, late = runs.run_sessions(read(spark, path), at, "who", "ts", "value", GAP)
    assert late == 1 and found(got) == [("a", 100, 100, 1, 1.0), ("a", 500, 505, 2, 3.0)]


def test_a_row_joins_two_sessions(spark, tmp_path):
    path, at = str(tmp_path / "in"), str(tmp_path / "run")
    write(spark, [("a", 100, 1.0), ("a", 118, 1.0)], path)
    assert len(found(runs.run_sessions(read(spark, path), at, "who", "ts", "value", GAP, "60 seconds")[0])) == 2
    write(spark, [("a", 109, 1.0)], path)
    assert found(runs.run_sessions(read(spark, path), at, "who", "ts", "value", GAP, "60 seconds")[0]) == [("a", 100, 118, 3, 3.0)]


def test_bins_go_on_after_a_stop(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.randint(0, 300), 0.0) for _ in range(80)]
    path, at = str(tmp_path / "in"), str(tmp_path / "run")
    want = lambda rows: sorted((t // 60 * 60, w) for w, t, _ in rows)
    for upto in (40, 80):
        write(spark, rows[upto - 40 : upto], path)
        got = runs.run_bins(read(spark, path), at, "who", "ts", "1 minute").select(F.unix_seconds("start").alias("s"), "key", "n").collect()
        assert sorted((r.s, r.key) for r in got for _ in range(r.n)) == want(rows[:upto])
