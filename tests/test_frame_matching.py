"""Frames are matched in their time buckets; trackers' tasks are as many for each core."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_target_frames import shuffled, tables
from trackloom.functions import kernels as k
from trackloom.operators import matching, scoring, tracking


def test_matched_is_the_least_of_all_ways():
    rng = np.random.default_rng(2)
    na, nb = rng.integers(0, 4, 60), rng.integers(0, 5, 60)
    a, b = rng.normal(0, 100, (na.sum(), 3)), rng.normal(0, 100, (nb.sum(), 3))
    frame_a, frame_b = np.repeat(np.arange(60), na), np.repeat(np.arange(60), nb)
    found = set(zip(*(x.tolist() for x in matching.matched(a, frame_a, b, frame_b, 120.0))))
    want = set()
    for f in range(60):
        i, j = np.flatnonzero(frame_a == f).tolist(), np.flatnonzero(frame_b == f).tolist()
        ways = [[*zip(i, p)] for p in itertools.permutations(j, len(i))] if len(i) <= len(j) else [[*zip(p, j)] for p in itertools.permutations(i, len(j))]
        best = min(ways, key=lambda w: sum(np.linalg.norm(a[x] - b[y]) for x, y in w))
        want |= {(x, y) for x, y in best if np.linalg.norm(a[x] - b[y]) <= 120.0}
    assert found == want and len(want) >= 15


@pytest.mark.parametrize("given", [False, True])
def test_same_scores_as_from_frames_of_truth(spark, given):
    fused, gt = tables(spark, scenarios=2)
    fused = fused.withColumn("x", F.when((F.col("scenario") == "s1") & (F.col("time") > 90), F.lit(float("nan"))).otherwise(F.col("x"))).union(fused.filter("scenario = 's0'").limit(3).withColumn("scenario", F.lit("untrue")))
    times = fused.select("scenario", "time").distinct().filter("time > 20").union(spark.createDataFrame([("s1", 33.25), ("none", 1.0)], "scenario string, time double")) if given else None
    found = {r.scenario: r for r in scoring.tracking_metrics(fused, gt, times).collect()}
    kept = fused.join(times.distinct(), ["scenario", "time"], "left_semi") if given else fused
    want = {r.scenario: r for r in scoring.frame_scores(kept, scoring.truth_at(gt, times if given else fused)).collect()}
    assert found.keys() == want.keys() and want["s1"].total_tp > 20 and want["s1"].total_fn > 20 and sum(r.id_switches for r in want.values()) > 5
    for s, r in want.items():
        assert [x for x in found[s]] == [x if not isinstance(x, float) else pytest.approx(x, rel=1e-9) for x in r]


def test_the_truth_at_all_times_is_not_shuffled(spark):
    fused, gt = tables(spark, frames=600)
    rows = fused.count()
    before = shuffled(spark)
    scoring.tracking_metrics(fused, gt).collect()
    assert shuffled(spark) - before < 3 * rows


def test_every_core_has_scenarios(spark):
    null = [f"cast(null as {kind}) {name}" for name, kind in (c.split() for c in tracking.SENSOR.split(", ")) if name not in ("scenario", "time")]
    sensor = spark.range(400).selectExpr("cast(id % 40 as string) scenario", "cast(id as double) time", *null)
    dealt = tracking.by_scenario(sensor).groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.count_distinct("scenario").alias("own")).collect()
    assert len(dealt) == spark.sparkContext.defaultParallelism and sum(r.own for r in dealt) == 40 and sum(r.n for r in dealt) == 400


@pytest.mark.parametrize("size", [1, 5])
def test_a_check_of_eigenvalues_leaves_the_matrices_alone(size):
    rng = np.random.default_rng(size)
    half = rng.normal(size=(size, 2, 4, 4))
    p = half @ np.swapaxes(half, -1, -2) + 0.1 * np.eye(4)
    kept, bad = p.copy(), p.copy()
    bad[-1, 1] -= 5 * np.eye(4) * np.linalg.eigvalsh(bad[-1, 1])[0]
    assert k.all_over(p, 1e-6) and not k.all_over(bad, 1e-6) and (p == kept).all()
