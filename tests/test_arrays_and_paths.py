import math
import random

import numpy as np
from pyspark.sql import functions as F

from trackloom.functions import arrays as m
from trackloom.operators import paths


def test_matrices(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(30):
        a = rng.normal(size=(3, 3))
        p = a @ a.T + 0.1 * np.eye(3) if k else np.diag([1.0, -1.0, 1.0])
        rows.append((k, p.tolist(), p[:2, :2].tolist(), rng.normal(size=3).tolist()))
    df = spark.createDataFrame(rows, "k int, p array<array<double>>, q array<array<double>>, x array<double>")
    x2 = F.slice("x", 1, 2)
    p, q, x = (F.col(c) for c in "pqx")
    got = df.select("k", m.inverse(p, 3).alias("i3"), m.inverse(q, 2).alias("i2"), m.log_determinant(p, 3).alias("l3"), m.mahalanobis(q, x2, 2).alias("d2"), m.log_likelihood(p, x, 3).alias("ll"), m.log_sum_exp(x).alias("lse"), m.posterior(F.transform(x, lambda v: F.abs(v)), x).alias("w")).collect()
    for r, (k, p, q, x) in zip(sorted(got), rows):
        if k == 0:
            assert r.i3 is None and r.l3 is None and r.ll is None
            continue
        p, q, x = np.array(p), np.array(q), np.array(x)
        assert np.allclose(r.i3, np.linalg.inv(p)) and np.allclose(r.i2, np.linalg.inv(q)) and np.isclose(r.l3, np.linalg.slogdet(p)[1])
        assert np.isclose(r.d2, x[:2] @ np.linalg.inv(q) @ x[:2]) and np.isclose(r.lse, np.log(np.exp(x).sum()))
        assert np.isclose(r.ll, -0.5 * (x @ np.linalg.inv(p) @ x + np.linalg.slogdet(p)[1] + 3 * math.log(2 * math.pi)))
        w = np.abs(x) * np.exp(x)
        assert np.allclose(r.w, w / w.sum())


ROW = "g string, who string, t double, x double, y double, z double"


def test_closest_approach(spark):
    rng = random.Random(5)
    rows = [("g", w, t, *(rng.uniform(-50, 50) for _ in range(3))) for w in "abc" for t in sorted(rng.uniform(0, 60) for _ in range(9))]
    rows += [("h", "a", 0.0, 0.0, 0.0, 0.0), ("h", "a", 10.0, 10.0, 0.0, 0.0), ("h", "b", 2.0, 5.0, 5.0, 0.0), ("h", "b", 8.0, 5.0, -5.0, 0.0), ("h", "late", 20.0, 0.0, 0.0, 0.0), ("h", "late", 30.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, ROW)
    for bucket in (4.0, 1000.0):
        got = {(r.g, r.a, r.b): r.distance for r in paths.closest_approach(df, ["g"], "who", "t", bucket).collect()}
        assert set(got) == {("g", "a", "b"), ("g", "a", "c"), ("g", "b", "c"), ("h", "a", "b")} and got["h", "a", "b"] < 1e-9
        for (g, a, b), d in got.items():
            own = lambda w: np.array([r[2:] for r in rows if r[:2] == (g, w)])  # noqa: B023, E731
            p, q = own(a), own(b)
            t = np.linspace(max(p[0, 0], q[0, 0]), min(p[-1, 0], q[-1, 0]), 20001)
            at = lambda s: np.stack([np.interp(t, s[:, 0], s[:, k]) for k in (1, 2, 3)], 1)  # noqa: B023, E731
            dense = np.linalg.norm(at(p) - at(q), axis=1).min()
            assert d <= dense + 1e-9 and dense - d < 0.05


def test_arc(spark):
    rng = random.Random(6)
    rows = [("g", w, float(k), *(rng.uniform(-50, 50) for _ in range(3))) for w in "ab" for k in range(12)]
    rows += [("g", "still", float(k), 1.0, 2.0, 3.0) for k in range(3)] + [("g", "none", 0.0, None, 0.0, 0.0)]
    got = paths.resample_by_arc(spark.createDataFrame(rows, ROW), "who", ["t"], ["t"], 7.0).collect()
    for w in ("a", "b"):
        own = np.array([r[2:] for r in rows if r[1] == w])
        arc = np.concatenate([[0], np.cumsum(np.linalg.norm(np.diff(own[:, 1:], axis=0), axis=1))])
        found = sorted(tuple(r)[1:] for r in got if r.who == w)
        assert [f[0] for f in found] == list(range(int(arc[-1] // 7) + 1))
        for f in found:
            assert np.allclose(f[2:], [np.interp(f[1], arc, own[:, k]) for k in (1, 2, 3, 0)])
    assert [tuple(r) for r in got if r.who == "still"] == [("still", 0, 0.0, 1.0, 2.0, 3.0, 0.0)] and not [r for r in got if r.who == "none"]
