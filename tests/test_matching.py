import itertools
import math
import random

import numpy as np
import pytest

from trackloom.operators import matching


def least(cost):
    n, m = cost.shape
    if n > m:
        return least(cost.T)
    return min(sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))


def test_stack_is_least():
    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (2, 5), (3, 3), (5, 6)):
        rows, cols = rng.integers(0, n + 1, 40), np.full(40, m)
        cols = rng.integers(np.maximum(rows, 1), m + 1)
        cost = rng.random((40, n, m)) * 100
        cost[:, :, :] = np.where(np.arange(m) < cols[:, None, None], cost, np.inf)
        found = matching.assign_stack(cost, rows)
        for c, r, k, f in zip(cost, rows, cols, found):
            own = f[:r]
            assert (f[r:] == -1).all() and len(set(own.tolist())) == r and (own >= 0).all() and (own < k).all()
            assert not r or math.isclose(sum(c[i, j] for i, j in enumerate(own)), least(c[:r, :k]))


def test_equal_costs_give_a_whole_assignment():
    found = matching.assign_stack(np.zeros((3, 4, 4)), np.array([4, 4, 2]))
    assert [sorted(f[f >= 0].tolist()) for f in found][:2] == [[0, 1, 2, 3]] * 2 and (found[2] >= 0).sum() == 2


SIDE = "scenario string, time double, id string, x double, y double, z double"


@pytest.mark.parametrize("gate", [30.0, 1e9])
def test_frames(spark, gate):
    rng = random.Random(4)
    place = lambda: tuple(rng.uniform(0, 60) for _ in range(3))
    frames = [(f"s{k % 3}", float(k)) for k in range(60)]
    a = [(*f, f"t{i}", *place()) for f in frames for i in range(rng.choice([0, 1, 1, 2, 3, 5]))]
    b = [(*f, f"g{i}", *place()) for f in frames for i in range(rng.choice([0, 1, 2, 2, 4]))]
    a += [("s0", 0.0, "nan", float("nan"), 0.0, 0.0), ("s0", 999.0, "null", None, 0.0, 0.0)]
    got = matching.assigned(spark.createDataFrame(a, SIDE), spark.createDataFrame(b, SIDE.replace("id", "gt")), ["scenario", "time"], "id", "gt", gate).collect()
    assert sorted((r.scenario, r.time, r.id) for r in got if r.id) == sorted(x[:3] for x in a)
    assert sorted((r.scenario, r.time, r.gt) for r in got if r.gt) == sorted(x[:3] for x in b)
    at = {("a", *x[:3]): np.array(x[3:], float) for x in a} | {("b", *x[:3]): np.array(x[3:], float) for x in b}
    for f in frames:
        own = [r for r in got if (r.scenario, r.time) == f]
        pairs = [r for r in own if r.id and r.gt]
        assert all(r.distance <= gate and math.isclose(r.distance, np.linalg.norm(at["a", *f, r.id] - at["b", *f, r.gt])) for r in pairs)
        ia, ib = [x for x in a if x[:2] == f and x[2] != "nan"], [x for x in b if x[:2] == f]
        if gate > 1e6 and ia and ib:
            cost = np.array([[np.linalg.norm(np.array(x[3:]) - np.array(y[3:])) for y in ib] for x in ia])
            assert len(pairs) == min(cost.shape) and math.isclose(sum(r.distance for r in pairs), least(cost))


def test_empty(spark):
    none = spark.createDataFrame([], SIDE)
    assert matching.assigned(none, none.withColumnRenamed("id", "gt"), ["scenario", "time"], "id", "gt", 1.0).collect() == []
