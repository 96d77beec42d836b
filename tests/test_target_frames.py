"""Targets are scored where tracks and truth meet: same scores as from the truth at all times, which is not shuffled."""

import numpy as np
import pytest

from trackloom.operators import scoring

KINDS = "scenario string, time double, global_track_id string, " + ", ".join(f"{c} double" for c in scoring.TRACK[3:])


def tables(spark, scenarios=3, targets=6, frames=80):
    rng = np.random.default_rng(7)
    gt = [(f"s{s}", f"T{c}", float(t), *map(float, rng.normal(0, 300, 3)), 1.0, 2.0, 0.0) for s in range(scenarios) for c in range(targets) for t in rng.uniform(0, 100, 12)]
    gt += [("s0", "once", 50.0, *[0.0] * 6), ("s0", "T0", gt[0][2], 1e4, *[0.0] * 5)]
    fused = [(f"s{s}", float(t), f"GT-{n}", *map(float, rng.normal(0, 300, 3)), 1.0, 2.0, 0.0, *[None] * 6, 20.0, 1.0) for s in range(scenarios) for t in rng.uniform(-5, 105, frames) for n in range(1 + int(t) % 2)]
    return spark.createDataFrame(fused, KINDS), spark.createDataFrame(gt, "scenario string, callsign string, " + ", ".join(f"{c} double" for c in ("time", *scoring.AXES)))


def shuffled(spark) -> int:
    """Rows that stages have written to shuffles so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(s.shuffleWriteRecords() for s in sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava(stages))


@pytest.mark.parametrize("given", [False, True])
def test_same_scores_as_from_the_truth_at_all_times(spark, given):
    fused, gt = tables(spark)
    times = fused.select("scenario", "time").distinct().filter("time > 20").union(spark.createDataFrame([("s1", 33.25)], "scenario string, time double")) if given else None
    found = {(r.scenario, r.callsign): r for r in scoring.target_metrics(fused, gt, times).collect()}
    want = {(r.scenario, r.callsign): r for r in scoring.target_scores(fused, scoring.truth_at(gt, times if given else fused), 400.0).collect()}
    assert found.keys() == want.keys() and len(want) == 18 and sum(r.total_tp for r in want.values()) > 50 and sum(r.total_fp for r in want.values()) > 5
    for k, r in want.items():
        assert list(found[k].asDict()) == list(r.asDict())
        assert [x for x in found[k]] == [x if not isinstance(x, float) else pytest.approx(x, rel=1e-9) for x in r]


def test_tracks_are_shuffled_once_and_the_truth_at_their_times_is_not(spark):
    fused, gt = tables(spark, frames=600)
    rows = fused.count()
    before = shuffled(spark)
    scoring.target_metrics(fused, gt).collect()
    assert shuffled(spark) - before < 2 * rows
