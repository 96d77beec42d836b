import itertools

import numpy as np
import pytest

from trackloom.functions import kernels as k
from trackloom.operators import tracking as t


def test_assignment_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n, m = rng.integers(1, 6, 2)
        cost = rng.random((n, m)) * 10
        cost[rng.random((n, m)) < 0.2] = 1e9
        got = k.assign(cost)
        assert len(got) == min(n, m) and len({i for i, _ in got}) == len({j for _, j in got}) == min(n, m)
        small = cost if n <= m else cost.T
        best = min(sum(small[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(small.shape[1]), small.shape[0]))
        assert abs(sum(cost[i, j] for i, j in got) - best) < 1e-6


def test_covariance_intersection_has_the_least_trace():
    rng = np.random.default_rng(1)
    a, b = (x @ x.T + np.eye(4) for x in rng.normal(size=(2, 4, 4)))
    _, p = k.covariance_intersection(np.zeros(4), a, np.ones(4), b)
    traces = [np.trace(np.linalg.inv(w * np.linalg.inv(a) + (1 - w) * np.linalg.inv(b))) for w in np.linspace(1e-3, 1 - 1e-3, 2000)]
    assert np.trace(p) <= min(traces) + 1e-4


def test_white_jerk_noise():
    _, q = k.model_acceleration(2.0)
    assert q[0, 0] == pytest.approx(2.25 * 2**5 / 20) and q[2, 2] == pytest.approx(2.25 * 2)
    _, q = k.model_acceleration(2.0, 4.0)
    assert q[0, 0] == pytest.approx(2 * q[6, 6])


def measurement(x, tq=15, sensor="R1", local="1", var=(25.0, 0.25)):
    return t.Measurement(np.array(x, float), np.diag([*var] * 3), tq, sensor, (sensor, local))


def fresh(policy, x=(0,) * 6, tq=15):
    m = measurement(x, tq)
    track = t.Track("GT-0001", 0.0, m.z, m.r, t.start_probability(tq), 0.0, 0.0, sensors={"R1"})
    policy.init(track, m)
    return track


def test_manoeuvre_adaptation():
    policy = t.Advanced()
    a = fresh(policy)
    assert (a.q_scale, a.nis, a.score, policy.gate(a)) == (1.0, 0.0, 0.0, 22.5)
    policy.adapt(a, 20.0)
    assert a.score <= 0.6 and policy.gate(a) == 22.5
    for _ in range(7):
        policy.adapt(a, 20.0)
    assert a.q_scale > 1 and 22.5 < policy.gate(a) <= 40.5
    fixed = t.Advanced(adaptive=False)
    b = fresh(fixed)
    for _ in range(8):
        fixed.adapt(b, 20.0)
    assert b.q_scale == 1 and b.score > 0.6 and fixed.gate(b) > 22.5


def test_decay_and_confirmation():
    policy = t.Advanced()
    a = fresh(policy)
    policy.predict(a, 2.0)
    assert a.prob == pytest.approx(0.8 * 0.97**2)
    a.prob, a.hits, a.time, a.seen = 0.95, 6, 8.0, 8.0
    policy.status(a)
    assert a.status == "TENTATIVE"
    a.sensors.add("R2")
    policy.status(a)
    assert a.status == "CONFIRMED"
    a.prob = 0.5
    policy.status(a)
    assert a.status == "CONFIRMED" and policy.emits(a)
    a.time = 10.5
    assert not policy.emits(a)


@pytest.mark.parametrize(("x", "var"), [((0, 121, 0, 0, 0, 0), (1, 1e6)), ((751, 0, 0, 0, 0, 0), (0, 30000.0)), ((0, 100, 0, 0, 0, 0), (1, 500.0))])
def test_physical_gates(x, var):
    policy = t.Advanced()
    a = fresh(policy)
    a.p = np.eye(9)
    m = measurement(x)
    m.r[var[0], var[0]] = var[1]
    cost, distance = policy.costs([a], [m])
    assert distance[0, 0] < 22.5 and not np.isfinite(cost[0, 0])


def motion(kind, n=30):
    out, turn = [], np.radians(1.5)
    for i in range(n):
        if kind == "CV":
            out.append((100.0 * i, 100.0, 0.0, 0.0))
        elif kind == "CA":
            out.append((100.0 * i + 2.0 * i * i, 100.0 + 4.0 * i, 0.0, 0.0))
        else:
            a = turn * i
            out.append((200 / turn * np.sin(a), 200 * np.cos(a), 200 / turn * (1 - np.cos(a)), 200 * np.sin(a)))
    return out


@pytest.mark.parametrize("kind", ["CV", "CA", "CT_LEFT"])
def test_imm_modes(kind):
    engine, dominant = t.Engine("imm"), None
    for i, (x, vx, y, vy) in enumerate(motion(kind)):
        engine.step(float(i), [measurement((x, vx, y, vy, 1000.0, 0.0), sensor=f"R{i % 2}")])
        for track in engine.tracks:
            assert np.linalg.eigvalsh(track.p).min() >= -1e-9
            assert abs(track.modes["xy"][2].sum() - 1) < 1e-12 and abs(track.modes["z"][2].sum() - 1) < 1e-12
    dominant = engine.policy.dominant(engine.tracks[0])[0]
    assert dominant == kind


def test_imm_gap():
    engine = t.Engine("imm")
    for i in range(4):
        engine.step(float(i), [measurement((100.0 * i, 100, 0, 0, 0, 0), sensor=f"R{i % 2}")])
    track = engine.tracks[0]
    assert track.status == "CONFIRMED"
    before = track.prob
    engine.policy.predict(track, 7.0)
    assert track.status != "DELETED" and track.prob < before


@pytest.mark.parametrize("algorithm", ["basic", "advanced", "imm"])
def test_two_targets_stay_two_tracks(algorithm):
    engine, rows = t.Engine(algorithm), []
    rng = np.random.default_rng(0)
    for i in range(40):
        ms = []
        for j, (sx, sy) in enumerate(((0, 0), (40000, 40000))):
            ms.append(measurement((sx + 150 * i + rng.normal(0, 5), 150, sy + rng.normal(0, 5), 0, 5000, 0), sensor=f"R{i % 2}", local=str(j)))
        rows.append({x.id for x in engine.step(float(i), ms)})
    assert rows[-1] and len(rows[-1]) == 2
