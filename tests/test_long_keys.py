import random

import pytest
from pyspark.sql import functions as F

from trackloom.operators import timeseries as ts

ROW = "key string, t double, id long"
SAMPLE = "key string, t double, v double"


def sides(spark):
    rng = random.Random(8)
    ask = [(rng.choice("ab"), float(rng.randint(-50, 400)), k) for k in range(300)] + [("a", None, 1000), ("c", 5.0, 1001), (None, 1.0, 1002)]
    # a stretch of many buckets without samples, times that repeat, and a key without any
    have = [(rng.choice("ab"), float(rng.choice([*range(40), *range(300, 330)])), float(k)) for k in range(90)] + [("a", None, 9.0), (None, 3.0, 7.0)]
    return spark.createDataFrame(ask, ROW), spark.createDataFrame(have, SAMPLE)


@pytest.mark.parametrize("edge", ["null", "clamp", "drop"])
def test_buckets_change_nothing(spark, edge):
    ask, have = sides(spark)
    plain = ts.interpolation_join(ask, have, "key", "t", ["v"], edge).withColumn("v", F.round("v", 9))
    for width in (1.0, 7.0, 1000.0):
        assert ts.same_rows(plain, ts.interpolation_join(ask, have, "key", "t", ["v"], edge, bucket=width).withColumn("v", F.round("v", 9)))


def test_nearest_in_buckets(spark):
    ask, have = sides(spark)
    for tolerance in (None, 5.0):
        plain = ts.nearest_join(ask, have, "key", "t", ["v"], tolerance)
        assert ts.same_rows(plain, ts.nearest_join(ask, have, "key", "t", ["v"], tolerance, bucket=3.0))


def test_no_bucket_holds_the_key(spark):
    """One key of many rows goes on as its buckets, and its carried samples add two rows to each at most."""
    have = spark.range(5000).select(F.lit("k").alias("key"), F.col("id").cast("double").alias("t"), F.rand(1).alias("v"))
    ask = spark.range(5000).select(F.lit("k").alias("key"), (F.col("id") + 0.5).alias("t"), "id")
    found = ts._aligned(ask, have, "key", "t", ["v"], 100.0)
    most = found.groupBy("key", "__bucket").count().agg(F.max("count")).first()[0]
    assert found.count() == 5000 and most == 100


def test_affine_scan(spark):
    rng = random.Random(2)
    rows = [(rng.choice("xyz"), float(k // 2), k, rng.uniform(-1, 1), rng.uniform(-2, 2), rng.uniform(0, 1)) for k in range(200)]
    df = spark.createDataFrame(rows, "key string, t double, id long, a double, b double, p0 double").withColumn("bucket", F.floor(F.col("t") / 13))
    got = {r.id: r.out for r in ts.affine_scan(df, "key", ["t", "id"], "a", "b", "p0", "bucket", "out").collect()}
    at = {}
    for key, t, k, a, b, p0 in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        at[key] = a * at.get(key, p0) + b
        assert abs(got[k] - at[key]) < 1e-9
    assert len(got) == len(rows)
    assert ts.affine_scan(df.limit(0), "key", ["t", "id"], "a", "b", "p0", "bucket", "out").collect() == []
