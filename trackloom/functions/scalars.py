"""Scalar functions of track data as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Quality 1..15 maps geometrically to a sigma between these bounds.
POSITION_SIGMA = (1500.0, 30.0)
VELOCITY_SIGMA = (25.0, 0.5)
EARTH_RADIUS_M = 6371000.0


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def quality_to_sigma(tq: Column, bounds: tuple[float, float]) -> Column:
    worst, best = bounds
    return F.lit(worst) * F.pow(F.lit(best / worst), (clip(tq, 1, 15) - 1) / 14.0)


def sigma_to_quality(sigma: Column, bounds: tuple[float, float]) -> Column:
    """Inverse of :func:`quality_to_sigma`, rounded half to even and clipped; non-positive sigma is the best quality."""
    import math

    worst, best = bounds
    raw = 1 + 14 * F.ln(sigma / worst) / math.log(best / worst)
    return F.when(sigma <= 0, 15).otherwise(clip(F.rint(raw), 1, 15)).cast("int")


def diagonal_covariance(sigma_pos: Column, sigma_vel: Column) -> Column:
    """Row-major 6 x 6 of (x, vx, y, vy, z, vz)."""
    p, v, zero = sigma_pos * sigma_pos, sigma_vel * sigma_vel, F.lit(0.0)
    return F.array(*[(v if k % 2 else p) if k == j else zero for k in range(6) for j in range(6)])


def enu_x(lon: Column, ref_lat: Column, ref_lon: Column) -> Column:
    return F.radians(lon - ref_lon) * EARTH_RADIUS_M * F.cos(F.radians(ref_lat))


def enu_y(lat: Column, ref_lat: Column) -> Column:
    return F.radians(lat - ref_lat) * EARTH_RADIUS_M


def enu_to_lat(y: Column, ref_lat: Column) -> Column:
    return ref_lat + F.degrees(y / EARTH_RADIUS_M)


def enu_to_lon(x: Column, ref_lat: Column, ref_lon: Column) -> Column:
    return ref_lon + F.degrees(x / (EARTH_RADIUS_M * F.cos(F.radians(ref_lat))))


def angle_difference(a: Column, b: Column) -> Column:
    """Signed difference in degrees, in [-180, 180)."""
    return F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0


def speed(vx: Column, vy: Column, vz: Column) -> Column:
    return F.sqrt(vx * vx + vy * vy + vz * vz)


def heading(vx: Column, vy: Column) -> Column:
    return F.degrees(F.atan2(vy, vx))


def track_id(prefix: str, n: Column, digits: int = 4) -> Column:
    return F.concat(F.lit(prefix), F.lpad(n.cast("string"), digits, "0"))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def is_close(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    return F.abs(a - b) <= tolerance


def entropy(p: Column) -> Column:
    """-sum p ln p of an array, zeros ignored."""
    return F.aggregate(p, F.lit(0.0), lambda acc, x: acc - F.when(x > 0, x * F.ln(x)).otherwise(0.0))


def normalise(p: Column, floor: float = 1e-12) -> Column:
    """Probabilities floored (non-finite count as the floor) and scaled to sum 1; floors and sum are computed once."""
    floored = F.transform(p, lambda x: F.when(finite(x), F.greatest(x, F.lit(floor))).otherwise(F.lit(floor)))
    total = lambda f: F.array(F.aggregate(f, F.lit(0.0), lambda a, y: a + y))
    # arrays of one element bind a value for what is inside
    return F.flatten(F.flatten(F.transform(F.array(floored), lambda f: F.transform(total(f), lambda t: F.transform(f, lambda x: x / t)))))


def dominant(names: tuple[str, ...], p: Column) -> Column:
    """Name of the largest probability; the first wins ties."""
    return F.element_at(F.array(*map(F.lit, names)), F.array_position(p, F.array_max(p)).cast("int"))


def in_view(x: Column, y: Column, z: Column, max_range: float, azimuth: tuple[float, float], elevation: tuple[float, float]) -> Column:
    """Inside range, azimuth sector (which may wrap over 0) and elevation band, in degrees."""
    ground = F.hypot(x, y)
    az, el = F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0)), F.degrees(F.atan2(z, F.greatest(ground, F.lit(1e-9))))
    a, b = (v % 360.0 for v in azimuth)
    whole = azimuth[1] - azimuth[0] >= 360
    sector = F.lit(True) if whole else ((az >= a) & (az <= b) if a <= b else (az >= a) | (az <= b))
    return (F.sqrt(x * x + y * y + z * z) <= max_range) & sector & el.between(*elevation)


def range_dependent_pd(r: Column, best: float, flat_to: float, end: float, floor: float) -> Column:
    """Flat, then linear down to ``floor`` at ``end``, then the floor."""
    return F.when(r <= flat_to, best).when(r >= end, floor).otherwise(best - (best - floor) * (r - flat_to) / (end - flat_to))


def radar_bucket(name: Column) -> Column:
    """A, B, C or OTHER: the last token between ``-`` and ``_`` that is one of the letters, else the last character."""
    upper = F.upper(F.trim(name))
    letters = ("A", "B", "C")
    token = F.try_element_at(F.filter(F.split(upper, "[-_]"), lambda t: t.isin(*letters)), F.lit(-1))
    last = F.right(upper, F.lit(1))
    return F.coalesce(token, F.when(last.isin(*letters), last), F.lit("OTHER"))


def decimal_comma(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), ",", ".").try_cast("double")


def initial_probability(tq: Column) -> Column:
    return 0.1 + 0.7 * (tq - 1) / 14.0


def effective_gate(score: Column, base: float = 22.5) -> Column:
    """Widened by up to 1.8 times for manoeuvring tracks."""
    return F.when(score > 0.6, F.least(base * (1 + 0.8 * score), F.lit(1.8 * base))).otherwise(F.lit(base))


def to_polar(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Range, azimuth from x to y, elevation; radians."""
    return speed(x, y, z), F.atan2(y, x), F.atan2(z, F.greatest(F.hypot(x, y), F.lit(1e-6)))


def sight_axes(az: Column, el: Column) -> list[list[Column]]:
    """Unit vectors along the line of sight, across and up."""
    ca, sa, ce, se = F.cos(az), F.sin(az), F.cos(el), F.sin(el)
    return [[ce * ca, ce * sa, se], [-sa, ca, F.lit(0.0)], [-se * ca, -se * sa, ce]]


def project(v: list[Column], axes: list[list[Column]]) -> list[Column]:
    """Components of a vector along each axis."""
    return [v[0] * a[0] + v[1] * a[1] + v[2] * a[2] for a in axes]


def vertical_variances(sigma_pos: Column, sigma_vel: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Variances of height and climb: blind without a height, else worse with range."""
    blind, wide = F.lit(1e6), 1.5 * sigma_vel
    return F.when(z.isNull(), blind).otherwise(sigma_pos * sigma_pos + F.pow(0.005 * F.hypot(x, y), 2)), F.when(z.isNull(), blind).otherwise(wide * wide)


def diagonal_distance(d: list[Column], variance: list[Column]) -> Column:
    """Squared Mahalanobis distance under independent errors."""
    terms = [x * x / v for x, v in zip(d, variance)]
    return sum(terms[1:], terms[0])


def physical_gate(away: Column, turn: Column, spread: Column, wobble: Column, since: Column) -> Column:
    """Whether place, velocity and acceleration of a measurement fit a track: 750 m or three sigmas, 120 m/s, and 30 m/s^2
    beyond three sigmas over the time unseen, a second at least."""
    return (away <= F.greatest(F.lit(750.0), 3 * spread)) & (turn <= 120.0) & (F.greatest(F.lit(0.0), turn - 3 * wobble) / F.greatest(since, F.lit(1.0)) <= 30.0)


def colour(index: Column, palette: tuple[str, ...]) -> Column:
    """An entry of a palette that starts anew after its end."""
    return F.element_at(F.array(*map(F.lit, palette)), (F.pmod(index, F.lit(len(palette))) + 1).cast("int"))


def exaggerated(z: Column, origin: Column, factor: float) -> Column:
    return origin + (z - origin) * factor


def scene_axes(x: Column, y: Column, z: Column, origin: tuple[Column, Column, Column], scale: float) -> tuple[Column, Column, Column]:
    """East, north, up as a scene's right, up, back."""
    return x - origin[0], (z - origin[2]) * scale, -(y - origin[1])


def at_epoch(seconds: Column, epoch: str = "1970-01-01 00:00:00") -> Column:
    """Relative seconds as a timestamp."""
    return F.timestamp_micros(F.unix_micros(F.lit(epoch).cast("timestamp")) + F.rint(seconds * 1e6).cast("long"))
