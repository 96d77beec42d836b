"""Rules of the trackers, computed by hand."""

import numpy as np
import pandas as pd
import pytest

from trackloom.functions import kernels as k
from trackloom.operators import tracking as t


def frame(**over):
    row = {"scenario": "s", "time": 0.0, "ord": 0, "sensor": "R", "local_track_id": "1", "callsign_true": "T", "x": 3000.0, "y": 4000.0, "z": 100.0, "vx": 1.0, "vy": 2.0, "vz": 3.0, "track_quality": 15, "sigma_pos_m": 10.0, "sigma_vel_mps": 2.0, "is_clutter": False}
    return pd.DataFrame([row | over])


def variances(policy, **over):
    ((_, (m,)),) = t.measurements(frame(**over), policy)
    return np.diag(m.r), m


def test_covariance_is_the_algorithms_own():
    for policy in (t.Basic(), t.Advanced()):
        assert variances(policy)[0] == pytest.approx([100, 4] * 3)
        # one bad sigma: both of the quality
        assert variances(policy, sigma_vel_mps=np.nan)[0] == pytest.approx([900, 0.25] * 3)
    # heights: sqrt(10^2 + (5000 * 0.005)^2), velocities 1.5 times as wide
    assert variances(t.Imm())[0] == pytest.approx([100, 4, 100, 4, 100 + 25.0**2, 9])
    assert variances(t.Imm(), sigma_vel_mps=np.nan)[0] == pytest.approx([100, 0.25, 100, 0.25, 725, 0.75**2])
    assert variances(t.Imm(), z=np.nan)[0] == pytest.approx([100, 4, 100, 4, 1e6, 1e6])


def test_missing_quality_is_the_best():
    r, m = variances(t.Basic(), track_quality=None, sigma_pos_m=None, sigma_vel_mps=None)
    assert m.tq == 15 and r == pytest.approx([900, 0.25] * 3)
    assert variances(t.Basic(), track_quality=1, sigma_pos_m=None, sigma_vel_mps=None)[0] == pytest.approx([1500.0**2, 625] * 3)


def test_polar_errors_turn_with_the_sight():
    polar = {"range": 1000.0, "azimuth": np.pi / 2, "elevation": 0.0, "sigma_range": 5.0, "sigma_az": 0.01, "sigma_el": 0.02}
    r, _ = variances(t.Imm(), **polar)
    assert r == pytest.approx([100, 4, 25, 4, 400, 4])  # along y the range's error, across it 1000 * 0.01
    rng = np.random.default_rng(0)
    n = 200_000
    rr, az, el = 1000 + 5 * rng.standard_normal(n), 0.6 + 0.01 * rng.standard_normal(n), 0.3 + 0.02 * rng.standard_normal(n)
    cloud = np.cov([rr * np.cos(el) * np.cos(az), rr * np.cos(el) * np.sin(az), rr * np.sin(el)])
    assert k.polar_covariance(1000.0, 0.6, 0.3, 5.0, 0.01, 0.02) == pytest.approx(cloud, rel=0.03, abs=2.0)


@pytest.mark.parametrize("algorithm", ["basic", "advanced", "imm"])
def test_no_track_of_no_place(algorithm):
    rows = pd.concat([frame(x=np.nan), frame(vy=np.inf, time=1.0), frame(time=np.nan)])
    engine = t.Engine(algorithm)
    for time, ms in t.measurements(rows, engine.policy):
        engine.step(time, ms)
    assert not engine.tracks


def test_emitted_sigmas_are_those_of_x():
    policy = t.Imm()
    _, m = variances(policy)
    _, track = t.Engine("imm")._create(0.0, m)
    track.prob = 0.123456
    row = t._row(policy, track, "s")
    assert (row["pos_sigma_m"], row["vel_sigma_mps"]) == (row["sigma_x_m"], row["sigma_vx_mps"]) == (pytest.approx(10.0), pytest.approx(2.0))
    assert row["fused_tq"] == 15 and row["prob"] == 0.123 and row["mode_prob_xy_cv"] == 0.7
    assert row["min_cov_eig"] > 0 and row["cov_condition_number"] == pytest.approx(row["max_cov_eig"] / row["min_cov_eig"])
    basic = t._row(t.Basic(), t.Engine("basic")._create(0.0, variances(t.Basic())[1])[1], "s")
    assert basic["ax"] is None and basic["fused_tq"] is None and basic["sigma_z_m"] == pytest.approx(10.0)


def test_stacked_filters_equal_single_ones():
    rng = np.random.default_rng(3)
    one, many, policy = t.Engine("imm"), t.Engine("imm"), t.Imm()
    ms = [t.Measurement(np.array([1e5 * j, 50.0 + j, 10.0 * j, -3.0, 3000.0, 1.0]), np.diag([100, 4, 100, 4, 900, 9.0]), 15, "R", ("R", str(j))) for j in range(5)]
    for e in (one, many):
        e.step(0.0, ms)
    for step in (1.0, 3.5, 4.0):
        moved = [t.Measurement(m.z + rng.normal(0, 3, 6), m.r, m.tq, m.sensor, m.source) for m in ms]
        for track, m in zip(one.tracks, moved):
            policy.predict(track, step)
            policy.update(track, m, 0.0)
        policy.predict_all(many.tracks, step)
        policy.update_all([(track, m, 0.0) for track, m in zip(many.tracks, moved)])
        for a, b in zip(one.tracks, many.tracks):
            assert a.x == pytest.approx(b.x, rel=1e-9, abs=1e-6) and a.p == pytest.approx(b.p, rel=1e-9, abs=1e-6)
            assert a.modes["xy"][2] == pytest.approx(b.modes["xy"][2], rel=1e-9)


def test_diagnosis_gives_the_gate_that_failed():
    engine, events = t.Engine("advanced"), []
    m = lambda x, source, vx=0.0: t.Measurement(np.array([x, vx, 0, 0, 0, 0.0]), np.diag([100, 4] * 3).astype(float), 15, "R", ("R", source), "T")
    engine.step(0.0, [m(0.0, "1")], events)
    engine.step(1.0, [m(5.0, "1")], events)
    engine.step(2.0, [m(5000.0, "1")], events)
    first, second, third = (e for e in events if e["event_type"] == "measurement")
    assert first["result"] == "SOURCE_MAP_NOT_FOUND;NO_ACTIVE_TRACK;NEW_TRACK_CREATED" and first["created_global_track_id"] == "GT-0001"
    assert second["result"] == "ACCEPTED" and second["accepted_global_track_id"] == "GT-0001" and second["d2"] < second["effective_gate"] == 22.5
    assert third["result"] == "MAHALANOBIS_GATE_FAIL;NEW_TRACK_CREATED" and third["position_innovation_m"] > 4000 and third["source_map_found"]
    engine.step(60.0, [], events)
    gone = [e for e in events if e["event_type"] == "track_deleted"]
    assert {e["assigned_global_track_id"] for e in gone} == {"GT-0001", "GT-0002"} and gone[0]["labels"] == ["T"] and gone[0]["was"] == "TENTATIVE"


def test_debug_summary(spark):
    from trackloom.operators import generators as g
    from trackloom.plans import api, queries

    sensor = g.simulate(queries.truth(spark, seconds=60.0)).persist()
    debug = api.association_debug(sensor).persist()
    rows = debug.filter("event_type = 'measurement'")
    assert rows.count() == sensor.count() and rows.filter("result is null or measurement_accepted <> (accepted_global_track_id is not null)").isEmpty()
    own = api.debug_summary(debug, "T1").first()
    assert own.total_measurements == own.accepted + own.rejected == sensor.filter("callsign_true = 'T1'").count()
    assert own.new_tracks == own.rejected and own.accepted > 0 and own.max_effective_gate >= 22.5
