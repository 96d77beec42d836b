"""Matrix kernels of tracking filters in NumPy, stacked over tracks, modes or measurements where they can be."""

from __future__ import annotations

import numpy as np

# Fixed values.
CHI2_997 = {2: 11.618285980628055, 3: 13.931422665512084, 4: 16.014326314940618}
TURN_RATE = np.radians(1.5)
LEAK = 1e-3
FLOOR_XY = np.array([25.0, 0.25, 0.01, 25.0, 0.25, 0.01])
FLOOR_Z = np.array([25.0, 0.25, 0.01])
MODES_XY = ("CV", "CA", "CT_LEFT", "CT_RIGHT")
MODES_Z = ("CV", "SINGER")
SWITCH_XY = np.array([[0.94, 0.03, 0.015, 0.015], [0.10, 0.80, 0.05, 0.05], [0.05, 0.03, 0.90, 0.02], [0.05, 0.03, 0.02, 0.90]])
SWITCH_Z = np.array([[0.90, 0.10], [0.10, 0.90]])
START_XY = np.array([0.70, 0.10, 0.10, 0.10])
START_Z = np.array([0.90, 0.10])


def blocks(*parts: np.ndarray) -> np.ndarray:
    """Block-diagonal matrices of stacks of blocks."""
    n = sum(p.shape[-1] for p in parts)
    out, at = np.zeros(np.broadcast_shapes(*(p.shape[:-2] for p in parts)) + (n, n)), 0
    for p in parts:
        m = p.shape[-1]
        out[..., at : at + m, at : at + m] = p
        at += m
    return out


def of_steps(rows: list[list], dt: np.ndarray) -> np.ndarray:
    """A matrix of numbers and arrays like ``dt`` as a stack of matrices."""
    out = np.empty(dt.shape + (len(rows), len(rows[0])))
    for i, row in enumerate(rows):
        for j, value in enumerate(row):
            out[..., i, j] = value
    return out


# The models take one step in time or an array of steps, and give a stack of matrices for each.


def white_jerk(dt: np.ndarray | float, q: np.ndarray | float) -> np.ndarray:
    k = np.arange(3)
    power = 5 - k[:, None] - k[None, :]
    scale = np.array([[20.0, 8.0, 6.0], [8.0, 3.0, 2.0], [6.0, 2.0, 1.0]])
    return np.asarray(q)[..., None, None] * np.asarray(dt)[..., None, None] ** power / scale


def white_acceleration(dt: np.ndarray | float, q: float) -> np.ndarray:
    dt = np.asarray(dt, float)
    return q * of_steps([[dt**3 / 3, dt**2 / 2], [dt**2 / 2, dt]], dt)


def shift(dt: np.ndarray | float, order: int) -> np.ndarray:
    """Taylor transition of position and its derivatives."""
    from math import factorial

    dt = np.asarray(dt, float)
    return of_steps([[dt ** (j - i) / factorial(j - i) if j >= i else 0.0 for j in range(order)] for i in range(order)], dt)


def model_basic(dt: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    dt = np.asarray(dt, float)
    noise = of_steps([[(0.5 * dt * dt) ** 2, 0.0], [0.0, dt * dt]], dt)
    return blocks(*[shift(dt, 2)] * 3), blocks(*[noise] * 3)


def model_acceleration(dt: np.ndarray | float, q_scale: np.ndarray | float = 1.0, adaptive: bool = True) -> tuple[np.ndarray, np.ndarray]:
    q_scale = np.asarray(q_scale, float)
    q = white_jerk(dt, 1.5**2 * (q_scale if adaptive else 1.0))
    xy = q * np.where(q_scale > 2.0, 2.0, 1.0)[..., None, None]
    return blocks(*[shift(dt, 3)] * 3), blocks(xy, xy, q)


def models_xy(dt: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """Transitions and noises of MODES_XY, stacked."""
    dt = np.asarray(dt, float)
    straight = blocks(shift(dt, 2), np.zeros((1, 1)))
    noise = lambda q: blocks(white_acceleration(dt, q), np.full((1, 1), LEAK))
    f = [blocks(straight, straight), blocks(shift(dt, 3), shift(dt, 3))]
    seen = np.array([0, 1, 3, 4])
    for w in (TURN_RATE, -TURN_RATE):
        s, c = np.sin(w * dt), np.cos(w * dt)
        turn = np.zeros(dt.shape + (6, 6))
        turn[..., seen[:, None], seen] = of_steps([[1, s / w, 0, -(1 - c) / w], [0, c, 0, -s], [0, (1 - c) / w, 1, s / w], [0, s, 0, c]], dt)
        f.append(turn)
    q = [noise(0.4**2), white_jerk(dt, 8.0**2), noise(2.0**2), noise(2.0**2)]
    return np.stack(f, -3), np.stack([blocks(x, x) for x in q], -3)


def models_z(dt: np.ndarray | float, tau: float = 10.0, sigma: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Transitions and noises of MODES_Z, stacked: constant velocity, and Singer's correlated acceleration."""
    dt = np.asarray(dt, float)
    a, u = 1 / tau, dt / tau
    e, e2 = np.exp(-u), np.exp(-2 * u)
    singer = of_steps([[1, dt, (e + u - 1) / a**2], [0, 1, (1 - e) / a], [0, 0, e]], dt)
    q11 = (1 - e2 + 2 * u + 2 * u**3 / 3 - 2 * u**2 - 4 * u * e) / (2 * a**5)
    q12 = (e2 + 1 - 2 * e + 2 * u * e - 2 * u + u**2) / (2 * a**4)
    q13 = (1 - e2 - 2 * u * e) / (2 * a**3)
    q22 = (4 * e - 3 - e2 + 2 * u) / (2 * a**3)
    q23 = (e2 + 1 - 2 * e) / (2 * a**2)
    q33 = (1 - e2) / (2 * a)
    noise = 2 * a * sigma**2 * of_steps([[q11, q12, q13], [q12, q22, q23], [q13, q23, q33]], dt)
    return np.stack([blocks(shift(dt, 2), np.ones((1, 1))), singer], -3), np.stack([blocks(white_acceleration(dt, 0.2**2), np.full((1, 1), LEAK)), noise], -3)


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of matrices; where one of a stack is singular, each is solved alone."""
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(a) @ b if a.ndim == 2 else np.array([solve(*both) for both in zip(a, b)])


def all_over(p: np.ndarray, least: float) -> bool:
    """Whether all eigenvalues of a stack are surely over ``least``: then all pivots of an elimination are over 0. The stack goes
    last, so that a step is a few operations on long vectors; a tenth of the cost of a factor of each matrix."""
    n = p.shape[-1]
    a = p.reshape(-1, n * n).T.copy().reshape(n, n, -1)
    a[np.arange(n), np.arange(n)] -= least
    for k in range(n):
        if not (a[k, k] > 0).all():
            return False
        # the matrix is symmetric: rows from the diagonal on
        part = a[k, k + 1 :] / a[k, k]
        for i in range(k + 1, n):
            a[i, i:] -= part[i - k - 1] * a[k, i:]
    return True


def regular(p: np.ndarray, floor: np.ndarray | None = None, least: float = 1e-6) -> np.ndarray:
    """Symmetric, finite, diagonal at or over ``floor``, eigenvalues at or over ``least``; any stack of matrices."""
    p = 0.5 * (p + np.swapaxes(p, -1, -2))
    if not np.isfinite(p).all():
        p = np.nan_to_num(p, nan=0.0, posinf=1e12, neginf=-1e12)
    k = np.arange(p.shape[-1])
    p[..., k, k] = np.maximum(p[..., k, k], least if floor is None else floor)
    if all_over(p, least):
        return p
    value, vector = np.linalg.eigh(p)
    bad = (value < least).any(-1)
    if bad.any():
        value, vector = np.maximum(value[bad], least), vector[bad]
        fixed = (vector * value[..., None, :]) @ np.swapaxes(vector, -1, -2)
        p[bad] = 0.5 * (fixed + np.swapaxes(fixed, -1, -2))
    return p


def mahalanobis(d: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Squared distances of stacked differences, infinite where not finite, never negative."""
    try:
        x = np.linalg.solve(s, d[..., None])[..., 0]
    except np.linalg.LinAlgError:
        if s.ndim > 2:  # a singular one changes nothing of the others
            d = np.broadcast_to(d, s.shape[:-1])
            return np.array([mahalanobis(*both) for both in zip(d, s)])
        x = np.einsum("...ij,...j->...i", np.linalg.pinv(s), d)
    v = (d * x).sum(-1)
    return np.where(np.isfinite(v), np.maximum(v, 0.0), np.inf)


def log_likelihood(d: np.ndarray, s: np.ndarray) -> np.ndarray:
    sign, logdet = np.linalg.slogdet(s)
    v = -0.5 * (mahalanobis(d, s) + logdet + d.shape[-1] * np.log(2 * np.pi))
    return np.where((sign > 0) & np.isfinite(v), v, -np.inf)


def probabilities(p: np.ndarray, floor: float = 1e-12, axis: int = -1) -> np.ndarray:
    """Floored and scaled to sum 1 along ``axis``."""
    p = np.maximum(np.where(np.isfinite(p), p, floor), floor)
    return p / p.sum(axis, keepdims=True)


def posterior(prior: np.ndarray, loglik: np.ndarray) -> np.ndarray:
    """Mode probabilities of stacked mixtures after their likelihoods; the prior where none is finite."""
    raw = np.log(probabilities(prior)) + loglik
    some = np.isfinite(raw).any(-1, keepdims=True)
    most = np.where(some, raw.max(-1, keepdims=True), 0.0)
    return np.where(some, probabilities(np.exp(np.where(some, raw - most, 0.0))), probabilities(prior))


def joseph(x: np.ndarray, p: np.ndarray, z: np.ndarray, r: np.ndarray, seen: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Measurement update of stacked states that observes the components ``seen``."""
    p, r = regular(p, floor), regular(r)
    s = regular(p[..., seen[:, None], seen] + r)
    gain = np.swapaxes(np.linalg.solve(s, p[..., seen, :]), -1, -2)
    keep = np.broadcast_to(np.eye(p.shape[-1]), p.shape).copy()
    keep[..., :, seen] -= gain
    x = x + np.einsum("...ij,...j->...i", gain, z - x[..., seen])
    p = keep @ p @ np.swapaxes(keep, -1, -2) + gain @ r @ np.swapaxes(gain, -1, -2)
    return x, regular(p, floor)


def mix(x: np.ndarray, p: np.ndarray, mu: np.ndarray, switch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interacting-multiple-model mixing of stacked mixtures: mixed states and covariances for each mode, and predicted
    probabilities."""
    mu = probabilities(mu)
    ahead = probabilities(mu @ switch)
    w = probabilities(switch * mu[..., :, None] / ahead[..., None, :], axis=-2)
    into = np.swapaxes(w, -1, -2)
    x0 = into @ x
    d = x[..., None, :, :] - x0[..., :, None, :]
    p0 = (into @ p.reshape(p.shape[:-2] + (-1,))).reshape(p.shape) + np.swapaxes(into[..., None] * d, -1, -2) @ d
    return x0, p0, ahead


def moments(x: np.ndarray, p: np.ndarray, mu: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and covariances of stacked mixtures."""
    mean = (mu[..., None, :] @ x)[..., 0, :]
    d = x - mean[..., None, :]
    return mean, (mu[..., None, None] * p).sum(-3) + np.swapaxes(mu[..., None] * d, -1, -2) @ d


def cross_lmmse(x: np.ndarray, p: np.ndarray, z: np.ndarray, r: np.ndarray, rho: float = 0.4) -> tuple[np.ndarray, np.ndarray]:
    """Linear fusion under an assumed cross-covariance rho * sqrt(max(0, P * R)), element by element; any stack."""
    c = rho * np.sqrt(np.maximum(0.0, p * r))
    turned = np.swapaxes(p - c, -1, -2)
    gain = np.swapaxes(solve(np.swapaxes(p + r - c, -1, -2) - c, turned), -1, -2)
    return x + (gain @ (z - x)[..., None])[..., 0], p - gain @ turned


def standard_fuse(x: np.ndarray, p: np.ndarray, z: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gain = np.swapaxes(solve(np.swapaxes(p + r, -1, -2), np.swapaxes(p, -1, -2)), -1, -2)
    out = p - gain @ p
    return x + (gain @ (z - x)[..., None])[..., 0], 0.5 * (out + np.swapaxes(out, -1, -2))


def minimise(f, low: np.ndarray, high: np.ndarray, tolerance: float = 1e-6) -> np.ndarray:
    """Golden-section minima of unimodal functions, one for each element; brackets of one width."""
    ratio = (np.sqrt(5) - 1) / 2
    a, b = np.asarray(low, float), np.asarray(high, float)
    c, d = b - ratio * (b - a), a + ratio * (b - a)
    fc, fd = f(c), f(d)
    while b.size and (b - a).max() > tolerance:
        left = fc < fd
        a, b = np.where(left, a, c), np.where(left, d, b)
        near = np.where(left, b - ratio * (b - a), a + ratio * (b - a))
        c, d, now = np.where(left, near, d), np.where(left, c, near), f(near)
        fc, fd = np.where(left, now, fd), np.where(left, fc, now)
    return (a + b) / 2


def covariance_intersection(x: np.ndarray, p: np.ndarray, z: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fusion under unknown correlation, the weight of least trace; any stack.

    Both informations are diagonalised together once, so a trial weight costs a weighted sum, not an inverse."""
    pi, ri = np.linalg.inv(p), np.linalg.inv(r)
    half = np.linalg.cholesky(0.5 * (p + np.swapaxes(p, -1, -2)))
    value, vector = np.linalg.eigh(np.swapaxes(half, -1, -2) @ ri @ half)
    basis = half @ vector
    weight = (basis * basis).sum(-2)
    ends = np.zeros(p.shape[:-2])
    w = minimise(lambda t: (weight / (t[..., None] + (1 - t[..., None]) * value)).sum(-1), ends + 1e-3, ends + 1 - 1e-3)[..., None, None]
    out = np.linalg.inv(w * pi + (1 - w) * ri)
    out = 0.5 * (out + np.swapaxes(out, -1, -2))
    return (out @ (w * pi @ x[..., None] + (1 - w) * ri @ z[..., None]))[..., 0], out


def pad_acceleration(z: np.ndarray, r: np.ndarray, variance: float = 1e5) -> tuple[np.ndarray, np.ndarray]:
    """(x, vx, y, vy, z, vz) as (x, vx, ax, ...): zero accelerations of large variance, axes uncorrelated; any stack."""
    at = np.array([0, 1, 3, 4, 6, 7])
    x, p = np.zeros(z.shape[:-1] + (9,)), np.zeros(r.shape[:-2] + (9, 9)) + np.eye(9) * variance
    x[..., at] = z
    for k in (0, 2, 4):
        p[..., at[k : k + 2, None], at[k : k + 2]] = r[..., k : k + 2, k : k + 2]
    return x, p


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Minimum-cost assignment of a rectangular matrix: shortest augmenting paths with potentials."""
    n, m = cost.shape
    if not n or not m:
        return []
    if n > m:
        return sorted((i, j) for j, i in assign(cost.T))
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner, way = np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j] = True
            row = owner[j]
            now = cost[row - 1] - u[row] - v[1:]
            open_ = ~used[1:]
            better = open_ & (now < least[1:])
            least[1:][better] = now[better]
            way[1:][better] = j
            nxt = 1 + int(np.argmin(np.where(open_, least[1:], np.inf)))
            step = least[nxt]
            u[owner[used]] += step
            v[used] -= step
            least[1:][open_] -= step
            j = nxt
            if owner[j] == 0:
                break
        while j:
            owner[j] = owner[way[j]]
            j = way[j]
    return sorted((int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j])


def polar_covariance(r: np.ndarray, az: np.ndarray, el: np.ndarray, s_r: np.ndarray, s_az: np.ndarray, s_el: np.ndarray) -> np.ndarray:
    """Position covariances of range, azimuth (from x to y), elevation measurements of independent errors."""
    r = np.asarray(r, float)
    ce, se, ca, sa = np.cos(el), np.sin(el), np.cos(az), np.sin(az)
    j = of_steps([[ce * ca, -r * ce * sa, -r * se * ca], [ce * sa, r * ce * ca, -r * se * sa], [se, 0.0, r * ce]], r)
    d = of_steps([[np.square(s_r), 0.0, 0.0], [0.0, np.square(s_az), 0.0], [0.0, 0.0, np.square(s_el)]], r)
    return j @ d @ np.swapaxes(j, -1, -2)
