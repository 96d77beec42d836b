"""Trajectories and simulated sensors as DataFrames. Random draws are hashes of (seed, row identity, purpose): a row's draws
do not depend on partitions, order or retries."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.functions import scalars as s
from trackloom.operators.timeseries import gradient, interpolation_join, ordered, realigned, unwrap
from trackloom.sources.store import settled

GT = ["scenario", "callsign", "time", "x", "y", "z", "vx", "vy", "vz"]


def uniform(seed: int, *identity) -> Column:
    """In (0, 1)."""
    parts = [F.lit(x) if isinstance(x, (str, int)) else x for x in identity]
    return (F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 48)) + 0.5) / float(1 << 48)


def normal(seed: int, *identity) -> Column:
    return F.sqrt(-2 * F.ln(uniform(seed, "radius", *identity))) * F.cos(2 * math.pi * uniform(seed, "angle", *identity))


def poisson(mean: float, seed: int, *identity) -> Column:
    """By inversion, to 12 sigma past the mean."""
    top, p, total, out = int(mean + 12 * math.sqrt(mean) + 12), math.exp(-mean), 0.0, F.lit(0)
    u = uniform(seed, "poisson", *identity)
    for k in range(top):
        total += p
        out = out + F.when(u > total, 1).otherwise(0)
        p *= mean / (k + 1)
    return out


# --- trajectories


def line_route(spark: SparkSession, scenario: str, callsign: str, start: tuple, velocity: tuple, end: float, step: float = 1.0) -> DataFrame:
    t = F.col("id") * step
    at = [F.lit(float(a)) + float(v) * t for a, v in zip(start, velocity)]
    return spark.range(int(end / step) + 1).select(F.lit(scenario).alias("scenario"), F.lit(callsign).alias("callsign"), t.alias("time"), *(c.alias(n) for n, c in zip("xyz", at)), *(F.lit(float(v)).alias(f"v{n}") for n, v in zip("xyz", velocity)))


def mirror_route(gt: DataFrame, callsign: str, axis: str = "x") -> DataFrame:
    """Reflected about the mean of the axis, by scenario."""
    centre = gt.groupBy("scenario").agg(F.avg(axis).alias("__c"))
    return gt.join(centre, "scenario").withColumns({axis: 2 * F.col("__c") - F.col(axis), f"v{axis}": -F.col(f"v{axis}"), "callsign": F.lit(callsign)}).select(*gt.columns)


def weave_route(gt: DataFrame, callsign: str, amplitude: float, period: float, axis: str = "y") -> DataFrame:
    """A sine across the track on top of the mirrored route: 3000 m in 100 s is smooth, 15000 m in 50 s is sharp."""
    w = 2 * math.pi / period
    m = mirror_route(gt, callsign, axis)
    return m.withColumns({axis: F.col(axis) + amplitude * F.sin(w * F.col("time")), f"v{axis}": F.col(f"v{axis}") + amplitude * w * F.cos(w * F.col("time"))})


@dataclass(frozen=True)
class Spiral:
    hz: float = 20.0
    speed: float = 77.0
    turns: float = 4.0
    radius: tuple[float, float] = (500.0, 1800.0)
    climb: float = 5.0
    centre: tuple[float, float] = (100000.0, 100000.0)
    z0: float = 3000.0
    direction: int = 1

    def __post_init__(self):
        if min(self.hz, self.speed, self.turns, *self.radius) <= 0 or self.climb >= self.speed:
            raise ValueError("spiral parameters must be positive and the climb slower than the speed")

    def length(self) -> float:
        """Arc length in the plane, r(theta) linear."""
        b = (self.radius[1] - self.radius[0]) / (2 * math.pi * self.turns)
        f = lambda r: (r * math.hypot(r, b) + b * b * math.asinh(r / b)) / (2 * b) if b else r
        return f(self.radius[1]) - f(self.radius[0]) if b else self.radius[0] * 2 * math.pi * self.turns

    def duration(self) -> float:
        return self.length() / math.sqrt(self.speed**2 - self.climb**2)

    def points(self) -> int:
        return int(self.duration() * self.hz) + 1


def spiral_route(spark: SparkSession, scenario: str, callsign: str, p: Spiral = Spiral()) -> DataFrame:
    """Climbing spiral of constant speed: the angle is resampled by arc length, velocities are second-order differences.
    One target's rows: the windows are over a scenario's callsign."""
    duration, turn = p.duration(), 2 * math.pi * p.turns
    n = p.points()
    fine = 4 * n
    radius = lambda th: p.radius[0] + (p.radius[1] - p.radius[0]) * th / turn
    b = (p.radius[1] - p.radius[0]) / turn
    theta = F.col("id") * (turn / fine)
    arc = lambda r: (r * F.hypot(r, F.lit(b)) + b * b * F.asinh(r / b)) / (2 * b)
    s0 = (p.radius[0] * math.hypot(p.radius[0], b) + b * b * math.asinh(p.radius[0] / b)) / (2 * b)
    curve = spark.range(fine + 1).select(F.lit(callsign).alias("callsign"), (arc(radius(theta)) - s0).alias("s"), theta.alias("theta"))
    ask = spark.range(n).select(F.lit(callsign).alias("callsign"), (F.col("id") / p.hz).alias("time"), F.least(F.col("id") * (p.length() / (duration * p.hz)), F.lit(p.length() * (1 - 1e-12))).alias("s"))
    at = interpolation_join(ask, curve, "callsign", "s", ["theta"], edge="clamp")
    r = radius(F.col("theta"))
    at = at.select(F.lit(scenario).alias("scenario"), "callsign", "time", (p.centre[0] + r * F.cos("theta")).alias("x"), (p.centre[1] + p.direction * r * F.sin("theta")).alias("y"), (p.z0 + p.climb * F.col("time")).alias("z"), "theta", r.alias("spiral_radius_m"))
    w = ordered("callsign", "time")
    out = at.withColumns({f"v{c}": gradient(c, "time", w) for c in "xyz"})
    out = out.withColumns({"speed": s.speed(F.col("vx"), F.col("vy"), F.col("vz")), "__h": F.atan2("vy", "vx")})
    out = out.withColumn("heading", unwrap("__h", w)).withColumns({"turn_rate": gradient("heading", "time", w), "climb_rate": F.col("vz"), "spiral_theta_rad": F.col("theta")})
    return out.drop("__h", "theta")


def derive_path(path: DataFrame, callsign: str, ref: tuple[float, float]) -> DataFrame:
    """Positions (time_unix, lat, lon, alt_m) as a trajectory: repeated times dropped, relative time, local coordinates,
    differenced velocity (steps of 0.1 s at least), clipped to 350 m/s and smoothed over three rows."""
    rows = path.dropDuplicates(["time_unix"]).withColumns({"callsign": F.lit(callsign), "x": s.enu_x(F.col("lon"), F.lit(ref[0]), F.lit(ref[1])), "y": s.enu_y(F.col("lat"), F.lit(ref[0])), "z": F.col("alt_m")})
    w = ordered("callsign", "time_unix")
    rows = rows.withColumn("time", F.col("time_unix") - F.min("time_unix").over(Window.partitionBy("callsign")))
    dt = F.greatest(F.coalesce(F.col("time") - F.lag("time").over(w), F.lit(1.0)), F.lit(0.1))
    raw = {f"v{c}": s.clip(F.coalesce((F.col(c) - F.lag(c).over(w)) / dt, F.lit(0.0)), -350.0, 350.0) for c in "xyz"}
    return rows.withColumns(raw).withColumns({f"v{c}": F.avg(f"v{c}").over(w.rowsBetween(-1, 1)) for c in "xyz"})


# --- sensors


def small_methods(spark: SparkSession) -> None:
    """HotSpot never compiles a method of over 8,000 bytes, and a stage of many draws is one: over that, Spark shall generate a
    method for each operator, which it splits. The session keeps a lower limit."""
    name = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(name, "65535")) > 8000:
        spark.conf.set(name, "8000")


@dataclass(frozen=True)
class Radar:
    name: str
    x: float
    y: float
    period: float
    jitter: float
    pd: float
    sigma_pos: float
    sigma_vel: float
    quality: int
    latency: float = 0.0
    max_range: float = 400_000.0
    clutter: float = 0.0
    realistic: bool = False
    # the rest is of simulate_realistic only
    z: float = 0.0
    bias: tuple[float, float, float] = (0.0, 0.0, 0.0)
    drift: float = 0.0
    quality_jitter: int = 1
    penalty: int = 0
    pd_range: float = 150_000.0
    pd_min: float = 0.3
    visible: float = 0.1
    azimuth: tuple[float, float] = (-180.0, 180.0)
    elevation: tuple[float, float] = (-90.0, 90.0)
    box: tuple[float, ...] = (-400_000.0, 400_000.0, -400_000.0, 400_000.0, 0.0, 15_000.0)


RADARS = (
    Radar("RADAR_A", 0.0, 0.0, 4.0, 0.1, 0.95, 60.0, 2.0, 12, 0.3, clutter=0.3),
    Radar("RADAR_B", 40_000.0, -20_000.0, 6.0, 0.2, 0.9, 90.0, 3.0, 10, 0.8, clutter=0.3),
    Radar("RADAR_C", -30_000.0, 35_000.0, 10.0, 0.3, 0.85, 140.0, 5.0, 8, 1.5, clutter=0.3),
)

#: The realistic radars of the reference; clutter is a count for each scan.
REALISTIC = (
    Radar("REAL_A", 0.0, 0.0, 2.5, 0.4, 0.95, 0.0, 0.0, 13, 0.3, 500_000.0, 0.000075, True, 0.0, (15.0, -10.0, 5.0), 0.05, 1, 3, 150_000.0, 0.5, 0.01),
    Radar("REAL_B", 50_000.0, -5_000.0, 5.0, 1.0, 0.88, 0.0, 0.0, 10, 0.8, 500_000.0, 0.00005, True, 0.0, (-25.0, 20.0, -7.0), 0.08, 2, 3, 120_000.0, 0.4, 0.00875),
    Radar("REAL_C", 15_000.0, 60_000.0, 10.0, 2.5, 0.8, 0.0, 0.0, 7, 1.5, 500_000.0, 0.000025, True, 0.0, (40.0, 35.0, 12.0), 0.12, 2, 2, 80_000.0, 0.3, 0.00575, box=(-100_000.0, 100_000.0, -100_000.0, 100_000.0, 0.0, 12_000.0)),
)
ANGLE_SIGMA = math.radians(0.05)


def scan_schedule(gt: DataFrame, radars: tuple[Radar, ...], seed: int) -> DataFrame:
    """``scenario, sensor, callsign, scan, scan_time``: jittered scans of each radar over each target's life."""
    spark = gt.sparkSession
    params = spark.createDataFrame([(r.name, r.period, r.jitter) for r in radars], "sensor string, period double, jitter double")
    lives = gt.groupBy("scenario", "callsign").agg(F.min("time").alias("t0"), F.max("time").alias("t1"))
    each = lives.join(F.broadcast(params))  # a row for each of a handful of radars
    scans = F.sequence(F.lit(0), (F.ceil((F.col("t1") - F.col("t0")) / (0.7 * F.col("period"))) + 2).cast("int"))
    rows = each.withColumn("scan", F.explode(scans))
    step = F.when(F.col("scan") == 0, uniform(seed, "phase", F.col("sensor"), F.col("callsign")) * F.col("period")).otherwise(F.greatest(F.col("period") + F.col("jitter") * normal(seed, "scan", F.col("sensor"), F.col("callsign"), F.col("scan")), F.lit(0.1)))
    w = Window.partitionBy("scenario", "sensor", "callsign").orderBy("scan").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("scan_time", F.col("t0") + F.sum(step).over(w)).filter("scan_time <= t1").select("scenario", "sensor", "callsign", "scan", "scan_time")


def simulate(gt: DataFrame, radars: tuple[Radar, ...] = RADARS, seed: int = 42) -> DataFrame:
    """Measurements of ``gt`` by ``radars`` with clutter: detection by chance (falling with range for realistic radars),
    noise on each axis, a constant bias, islands of one local track between misses, arrival stamps, and quality draws. A
    radar without sigmas of its own has its qualities', which fall in manoeuvres."""
    spark = gt.sparkSession
    small_methods(spark)
    fields = "sensor string, rx double, ry double, pd double, sp double, sv double, q int, late double, far double, clutter double, realistic boolean"
    params = F.broadcast(spark.createDataFrame([(r.name, r.x, r.y, r.pd, r.sigma_pos, r.sigma_vel, r.quality, r.latency, r.max_range, r.clutter, r.realistic) for r in radars], fields))
    scans = scan_schedule(gt, radars, seed).withColumns({"key": F.concat_ws("/", "scenario", "callsign"), "time": F.col("scan_time")})
    values = ["x", "y", "z", "vx", "vy", "vz", "dvx", "dvy"]
    truth = maneuvering(gt).withColumn("key", F.concat_ws("/", "scenario", "callsign")).select("key", "time", *values)
    seen = interpolation_join(scans, truth, "key", "time", values, edge="clamp").join(params, "sensor")
    r = F.sqrt(F.pow(F.col("x") - F.col("rx"), 2) + F.pow(F.col("y") - F.col("ry"), 2) + F.pow("z", 2))
    falling = F.coalesce(*(F.when(F.col("sensor") == x.name, s.range_dependent_pd(r, x.pd, x.pd_range, x.max_range, x.pd_min)) for x in radars))
    chance = F.when(F.col("realistic"), falling).otherwise(F.col("pd"))
    who = (F.col("sensor"), F.col("callsign"), F.col("scan"))
    hit = (uniform(seed, "hit", *who) <= chance) & (r <= F.col("far"))
    w = Window.partitionBy("scenario", "sensor", "callsign").orderBy("scan")
    seen = seen.withColumns({"hit": hit, "r": r}).withColumn("island", F.sum(F.when(F.lag("hit", 1, True).over(w), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spread = F.when(F.col("realistic"), F.sqrt(F.col("sp") * F.col("sp") + 2 * F.pow(F.col("r") * 0.001, 2))).otherwise(F.col("sp"))
    of = lambda f: F.coalesce(*(F.when(F.col("sensor") == r.name, F.lit(f(r))) for r in radars))
    own = F.col("sp") > 0
    turned = F.when(F.hypot("dvx", "dvy") > 5.0, of(lambda r: r.penalty)).otherwise(0)
    jitter = of(lambda r: r.quality_jitter)
    drawn = F.floor(uniform(seed, "tq", *who) * (2 * jitter + 1)) - jitter
    tq = s.clip(F.col("q") - F.when(own, F.floor(F.col("r") / 100_000.0)).otherwise(turned) + drawn, 1, 15).cast("int")
    spread = F.when(own, spread).otherwise(s.quality_to_sigma(tq, s.POSITION_SIGMA))
    wobble = F.when(F.col("sv") > 0, F.col("sv")).otherwise(s.quality_to_sigma(tq, s.VELOCITY_SIGMA))
    noisy = {c: F.col(c) + of(lambda r: float(r.bias[i])) + spread * normal(seed, c, *who) for i, c in enumerate("xyz")} | {f"v{c}": F.col(f"v{c}") + wobble * normal(seed, "v" + c, *who) for c in "xyz"}
    found = seen.filter("hit").select("scenario", F.round(F.col("scan_time") + F.col("late"), 2).alias("time"), "sensor", F.format_string("%s-%s-%03d", "sensor", "callsign", "island").alias("local_track_id"), F.col("callsign").alias("callsign_true"), *(c.alias(n) for n, c in noisy.items()), tq.alias("track_quality"), spread.alias("sigma_pos_m"), wobble.alias("sigma_vel_mps"), F.lit(False).alias("is_clutter"))
    # clutter: a Poisson count for each scan of the first target, uniform in the scenario's box
    box = gt.groupBy("scenario").agg(*(f(c).alias(f"{c}{n}") for c in "xyz" for n, f in ((0, F.min), (1, F.max))), F.min("callsign").alias("callsign"))
    count = F.coalesce(*(F.when(F.col("sensor") == x.name, poisson(x.clutter, seed, "clutter", F.col("sensor"), F.col("scan"))) for x in radars))
    noise = scan_schedule(gt, radars, seed).join(box, ["scenario", "callsign"]).join(params, "sensor")
    noise = noise.withColumn("n", count).filter("n > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    spot = (F.col("scenario"), F.col("sensor"), F.col("scan"), F.col("k"))
    place = {c: F.col(f"{c}0") - 5000 + (F.col(f"{c}1") - F.col(f"{c}0") + 10000) * uniform(seed, "at" + c, *spot) for c in "xyz"} | {f"v{c}": 400 * uniform(seed, "by" + c, *spot) - 200 for c in "xyz"}
    false = noise.select("scenario", F.round(F.col("scan_time") + F.col("late"), 2).alias("time"), "sensor", F.format_string("%s-C-%05d-%d", "sensor", "scan", "k").alias("local_track_id"), F.lit("CLUTTER").alias("callsign_true"), *(c.alias(n) for n, c in place.items()), (F.floor(uniform(seed, "ctq", *spot) * 3) + 1).cast("int").alias("track_quality"), F.col("sp").alias("sigma_pos_m"), F.col("sv").alias("sigma_vel_mps"), F.lit(True).alias("is_clutter"))
    both = found.unionByName(false)
    order = Window.partitionBy("scenario", "time").orderBy("sensor", "local_track_id")
    return both.withColumn("ord", F.row_number().over(order).cast("long"))


def maneuvering(gt: DataFrame) -> DataFrame:
    """``gt`` with ``dvx, dvy``, each row's velocity less the row's before; zero for targets of fewer than three rows."""
    w = Window.partitionBy("scenario", "callsign").orderBy("time")
    long = F.count("*").over(Window.partitionBy("scenario", "callsign")) >= 3
    return gt.withColumns({f"d{c}": F.when(long, F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0))).otherwise(0.0) for c in ("vx", "vy")})


def _ends(lives: DataFrame, first: Column, last: Column) -> DataFrame:
    """Two samples of each object's line: at ``first`` and at ``last``."""
    ends = lives.withColumns({"__a": first, "__b": last}).withColumn("time", F.explode(F.array("__a", "__b")))
    return ends.withColumns({c: F.col(c) + F.col(f"v{c}") * (F.col("time") - F.col("__a")) for c in "xyz"}).drop("__a", "__b")


def static_points(gt: DataFrame, n: int = 1, seed: int = 42, box: tuple[float, ...] = (-300_000.0, 300_000.0, -300_000.0, 300_000.0, 0.0, 15_000.0)) -> DataFrame:
    """GT rows and ``label`` of ``n`` points of each scenario that every radar sees, from 0 to the scenario's end."""
    own = gt.groupBy("scenario").agg(F.max("time").alias("t1")).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n))) if n else F.explode(F.array().cast("array<int>")))
    kind = F.element_at(F.array(*map(F.lit, ("building", "terrain", "metal", "mountain"))), (F.floor(4 * uniform(seed, "kind", F.col("scenario"), F.col("k"))) + 1).cast("int"))
    at = {c: box[2 * i] + (box[2 * i + 1] - box[2 * i]) * uniform(seed, "static" + c, F.col("scenario"), F.col("k")) for i, c in enumerate("xyz")}
    rows = own.withColumns(at | {f"v{c}": F.lit(0.0) for c in "xyz"} | {"callsign": F.format_string("SC%d", "k"), "label": F.concat(F.lit("STATIC_CLUTTER_"), kind)})
    return _ends(rows, F.lit(0.0), F.col("t1")).select(*GT, "label")


def ghost_tracks(gt: DataFrame, n: int = 1, seed: int = 42, life: tuple[float, float] = (50.0, 90.0), speeds: tuple[float, float] = (5.0, 15.0)) -> DataFrame:
    """GT rows and ``label`` of ``n`` slow straight tracks of each scenario, within ``life`` and the scenario's time."""
    own = gt.groupBy("scenario").agg(F.greatest(F.min("time"), F.lit(life[0])).alias("a"), F.least(F.max("time"), F.lit(life[1])).alias("b")).filter("a < b")
    own = own.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n))) if n else F.explode(F.array().cast("array<int>")))
    u = lambda name, low, high: low + (high - low) * uniform(seed, "ghost" + name, F.col("scenario"), F.col("k"))
    speed, angle = u("speed", *speeds), u("angle", 0.0, 2 * math.pi)
    rows = own.withColumns({"x": u("x", -200_000.0, 200_000.0), "y": u("y", -200_000.0, 200_000.0), "z": u("z", 500.0, 10_000.0), "vx": speed * F.cos(angle), "vy": speed * F.sin(angle), "vz": normal(seed, "ghostvz", F.col("scenario"), F.col("k")), "callsign": F.format_string("GH%d", "k"), "label": F.lit("GHOST_TRACK")})
    return _ends(rows, F.col("a"), F.col("b")).select(*GT, "label")


def simulate_realistic(gt: DataFrame, radars: tuple[Radar, ...] = REALISTIC, seed: int = 42, static: int = 1, ghosts: int = 1) -> DataFrame:
    """Measurements of ``gt`` with static points, ghosts and a little background clutter: detection falls with range inside
    the field of view, quality falls in manoeuvres, noise is polar, velocities are Doppler's, and a bias walks from scan to
    scan of a radar (targets in order; its last value holds for clutter)."""
    small_methods(gt.sparkSession)
    by = lambda f: F.coalesce(*(F.when(F.col("sensor") == r.name, f(r)) for r in radars))
    draw = lambda name, low, high: F.floor(low + (high - low + 1) * uniform(seed, name, *who))
    who = (F.col("scenario"), F.col("sensor"), F.col("callsign"), F.col("scan"))
    anchor = static_points(gt, 1, seed).withColumns({"callsign": F.lit("DC"), "label": F.lit("DYNAMIC_CLUTTER")})
    zero = {f"d{c}": F.lit(0.0) for c in ("vx", "vy")}
    things = maneuvering(gt).select(*GT, "dvx", "dvy", F.lit("target").alias("kind"), F.col("callsign").alias("label"))
    for kind, more in (("static", static_points(gt, static, seed)), ("ghost", ghost_tracks(gt, ghosts, seed)), ("dynamic", anchor)):
        things = things.unionByName(more.withColumns(zero | {"kind": F.lit(kind)}))
    # kinds may share a callsign
    things = things.withColumn("callsign", F.concat_ws(":", "kind", "callsign"))
    values = ["x", "y", "z", "vx", "vy", "vz", "dvx", "dvy"]
    scans = scan_schedule(things, radars, seed).filter("scan > 0").withColumns({"key": F.concat_ws("/", "scenario", "callsign"), "time": F.col("scan_time")})
    seen = interpolation_join(scans, things.withColumn("key", F.concat_ws("/", "scenario", "callsign")).select("key", "time", *values), "key", "time", values, edge="clamp")
    seen = seen.join(things.select("scenario", "callsign", "kind", "label").distinct(), ["scenario", "callsign"])
    # the walk: rows of targets in order; of clutter, which sorts after them, the sum over all
    walk = Window.partitionBy("scenario", "sensor").orderBy(F.when(F.col("kind") == "target", 0).otherwise(1), F.when(F.col("kind") == "target", F.col("callsign")), F.when(F.col("kind") == "target", F.col("scan")))
    for i, c in enumerate("xyz"):
        seen = seen.withColumn(f"b{c}", by(lambda r: F.lit(float(r.bias[i]))) + F.sum(F.when(F.col("kind") == "target", by(lambda r: F.lit(r.drift)) * normal(seed, "walk" + c, *who)).otherwise(0.0)).over(walk))
    spot = {c: F.when(F.col("kind") == "dynamic", F.lit(0.0)).otherwise(F.col(c) - by(lambda r: F.lit(float((r.x, r.y, r.z)[i])))) for i, c in enumerate("xyz")}
    seen = seen.withColumns({f"d{c}": e for c, e in spot.items()}).withColumns({"r": s.speed(F.col("dx"), F.col("dy"), F.col("dz")), "az": F.atan2("dy", "dx")})
    seen = seen.withColumn("el", F.atan2(F.col("dz"), F.greatest(F.hypot("dx", "dy"), F.lit(1e-6))))
    view = lambda x, y, z: by(lambda r: s.in_view(x, y, z, r.max_range, r.azimuth, r.elevation))
    chance = F.when(F.col("kind") == "target", by(lambda r: s.range_dependent_pd(F.col("r"), r.pd, r.pd_range, r.max_range, r.pd_min))).when(F.col("kind") == "static", by(lambda r: F.lit(r.visible))).otherwise(1.0)
    w = Window.partitionBy("scenario", "sensor", "callsign").orderBy("scan")
    seen = seen.withColumn("hit", view(F.col("dx"), F.col("dy"), F.col("dz")) & (uniform(seed, "hit", *who) <= chance))
    seen = seen.withColumn("island", F.sum(F.when(F.lag("hit", 1, True).over(w), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    turn = F.hypot("dvx", "dvy") > 5.0
    own_tq = by(lambda r: F.lit(r.quality) - F.when(turn, r.penalty).otherwise(0) + draw("tq", -r.quality_jitter, r.quality_jitter))
    tq = F.when(F.col("kind") == "target", own_tq).when(F.col("kind") == "static", draw("tq", 1, 3)).when(F.col("kind") == "ghost", draw("tq", 2, 5)).otherwise(draw("tq", 1, 2))
    seen = seen.withColumn("track_quality", s.clip(tq, 1, 15).cast("int")).withColumns({"sp": s.quality_to_sigma(F.col("track_quality"), s.POSITION_SIGMA), "sv": s.quality_to_sigma(F.col("track_quality"), s.VELOCITY_SIGMA)})
    seen = seen.withColumns({"rm": F.col("r") + F.col("sp") * normal(seed, "range", *who), "am": F.col("az") + ANGLE_SIGMA * normal(seed, "azimuth", *who), "em": F.col("el") + ANGLE_SIGMA * normal(seed, "elevation", *who)})

    along = s.project([F.col(f"v{c}") for c in "xyz"], s.sight_axes(F.col("az"), F.col("el")))
    radial = F.when(F.col("kind") == "ghost", 1.5).otherwise(1.0)
    seen = seen.withColumns({f"m{k}": v + F.col("sv") * k_sigma * normal(seed, f"doppler{k}", *who) for k, (v, k_sigma) in enumerate(zip(along, (radial, F.lit(4.0), F.lit(2.0))))})
    basis = s.sight_axes(F.col("am"), F.col("em"))
    place = {c: by(lambda r: F.lit(float((r.x, r.y, r.z)[i]))) + F.col(f"b{c}") + F.col("rm") * basis[0][i] for i, c in enumerate("xyz")}
    doppler = {c: F.col("m0") * basis[0][i] + F.col("m1") * basis[1][i] + F.col("m2") * basis[2][i] for i, c in enumerate("xyz")}
    velocity = {f"v{c}": F.when(F.col("kind") == "static", 2 * F.col("sv") * normal(seed, "still" + c, *who)).otherwise(e) for c, e in doppler.items()}
    late = F.round(F.col("scan_time") + by(lambda r: F.lit(r.latency)), 2).alias("time")
    spread = F.sqrt(F.col("sp") * F.col("sp") + 2 * F.pow(F.col("r") * ANGLE_SIGMA, 2)).alias("sigma_pos_m")
    name = F.when(F.col("kind") == "static", F.concat_ws("-", "sensor", "callsign")).otherwise(F.format_string("%s-%s-%03d", "sensor", "callsign", "island"))
    found = seen.filter("hit and kind <> 'dynamic'").select("scenario", late, "sensor", name.alias("local_track_id"), F.col("label").alias("callsign_true"), *(e.alias(c) for c, e in (place | velocity).items()), "track_quality", spread, F.col("sv").alias("sigma_vel_mps"), (F.col("kind") != "target").alias("is_clutter"))
    count = by(lambda r: poisson(0.3 * r.clutter, seed, "dynamic", *who))
    noise = seen.filter("kind = 'dynamic'").withColumn("n", count).filter("n > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    noise = noise.withColumns({c: by(lambda r: r.box[2 * i] + (r.box[2 * i + 1] - r.box[2 * i]) * uniform(seed, "at" + c, *who, F.col("k"))) for i, c in enumerate("xyz")})
    noise = noise.filter(view(*(F.col(c) - by(lambda r: F.lit(float((r.x, r.y, r.z)[i]))) for i, c in enumerate("xyz"))))
    false = noise.select("scenario", late, "sensor", F.format_string("%s-DC-%05d-%d", "sensor", "scan", "k").alias("local_track_id"), F.col("label").alias("callsign_true"), "x", "y", "z", *((0.2 * F.col("sv") * normal(seed, "by" + c, *who, F.col("k"))).alias(f"v{c}") for c in "xyz"), "track_quality", F.col("sp").alias("sigma_pos_m"), F.col("sv").alias("sigma_vel_mps"), F.lit(True).alias("is_clutter"))
    order = Window.partitionBy("scenario", "time").orderBy("sensor", "local_track_id")
    return found.unionByName(false).withColumn("ord", F.row_number().over(order).cast("long"))


@dataclass(frozen=True)
class FixedRadar:
    name: str
    period: float
    latency: float
    pd: float
    sigma_range: float
    sigma_vel: float
    sigma_degrees: float
    clutter: float


#: Radars that scan at one rate.
FIXED = (FixedRadar("RADAR_A", 2.5, 0.3, 0.95, 80.0, 2.0, 0.05, 0.04), FixedRadar("RADAR_B", 5.0, 0.8, 0.88, 150.0, 4.0, 0.08, 0.06), FixedRadar("RADAR_C", 10.0, 1.5, 0.8, 300.0, 7.0, 0.12, 0.08))


def simulate_fixed_rate(gt: DataFrame, radars: tuple[FixedRadar, ...] = FIXED, seed: int = 42) -> DataFrame:
    """Measurements of all targets of a scenario at common scan times, with ``arrival_time``: elevation, bearing and range with
    their errors, velocities with errors on each axis, and a Poisson count of clutter for each scan, uniform in the truth's
    box. ``time`` is the scan's."""
    small_methods(gt.sparkSession)
    of = lambda f: F.coalesce(*(F.when(F.col("sensor") == r.name, F.lit(f(r))) for r in radars))
    box = gt.groupBy("scenario").agg(F.min("time").alias("t0"), F.max("time").alias("t1"), *(f(c).alias(f"{c}{n}") for c in "xyz" for n, f in ((0, F.min), (1, F.max))))
    each = box.withColumn("sensor", F.explode(F.array(*(F.lit(r.name) for r in radars))))
    last = F.floor((F.col("t1") - F.col("t0")) / of(lambda r: r.period)).cast("int")
    scans = each.withColumn("scan", F.explode(F.sequence(F.lit(0), last))).withColumn("time", F.col("t0") + F.col("scan") * of(lambda r: r.period))
    lives = gt.groupBy("scenario", "callsign").agg(F.min("time").alias("born"), F.max("time").alias("gone"))
    ask = scans.select("scenario", "sensor", "scan", "time").join(lives, "scenario").filter(F.col("time").between(F.col("born"), F.col("gone")))
    who = (F.col("scenario"), F.col("sensor"), F.col("callsign"), F.col("scan"))
    ask = ask.filter(uniform(seed, "hit", *who) <= of(lambda r: r.pd)).withColumn("key", F.concat_ws("/", "scenario", "callsign"))
    values = ["x", "y", "z", "vx", "vy", "vz"]
    seen = interpolation_join(ask, gt.withColumn("key", F.concat_ws("/", "scenario", "callsign")).select("key", "time", *values), "key", "time", values, edge="clamp")
    r, az, el = s.to_polar(F.col("x"), F.col("y"), F.col("z"))
    angle = of(lambda r: math.radians(r.sigma_degrees))
    seen = seen.withColumns({"r": r + of(lambda r: r.sigma_range) * normal(seed, "range", *who), "az": az + angle * normal(seed, "bearing", *who), "el": el + angle * normal(seed, "elevation", *who)})
    at = {c: F.col("r") * u for c, u in zip("xyz", s.sight_axes(F.col("az"), F.col("el"))[0])} | {f"v{c}": F.col(f"v{c}") + of(lambda r: r.sigma_vel) * normal(seed, "v" + c, *who) for c in "xyz"}
    stamps = [F.round("time", 3).alias("time"), F.round(F.col("time") + of(lambda r: r.latency), 3).alias("arrival_time"), F.col("sensor")]
    found = seen.select("scenario", *stamps, F.concat_ws("-", "sensor", "callsign").alias("local_track_id"), F.col("callsign").alias("callsign_true"), *(c.alias(n) for n, c in at.items()), F.lit(10).alias("track_quality"), of(lambda r: r.sigma_range).alias("sigma_pos_m"), of(lambda r: r.sigma_vel).alias("sigma_vel_mps"), F.lit(False).alias("is_clutter"))
    count = F.coalesce(*(F.when(F.col("sensor") == r.name, poisson(r.clutter, seed, "clutter", F.col("scenario"), F.col("sensor"), F.col("scan"))) for r in radars))
    noise = scans.withColumn("n", count).filter("n > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    spot = (F.col("scenario"), F.col("sensor"), F.col("scan"), F.col("k"))
    place = {c: F.col(f"{c}0") + (F.col(f"{c}1") - F.col(f"{c}0")) * uniform(seed, "at" + c, *spot) for c in "xyz"} | {f"v{c}": wide * normal(seed, "by" + c, *spot) for c, wide in zip("xyz", (15.0, 15.0, 5.0))}
    false = noise.select("scenario", *stamps, F.format_string("%s-CL-%d-%d", "sensor", F.floor("time").cast("long"), F.col("k") - 1).alias("local_track_id"), F.lit("CLUTTER").alias("callsign_true"), *(c.alias(n) for n, c in place.items()), F.lit(2).alias("track_quality"), F.lit(1000.0).alias("sigma_pos_m"), F.lit(15.0).alias("sigma_vel_mps"), F.lit(True).alias("is_clutter"))
    order = Window.partitionBy("scenario", "time").orderBy("sensor", "local_track_id")
    return found.unionByName(false).withColumn("ord", F.row_number().over(order).cast("long"))


def target_measurements(gt: DataFrame, radars: tuple[Radar, ...] = REALISTIC, seed: int = 42, noise_scale: float = 1.0, detection_probability: float | None = None) -> DataFrame:
    """Measurements of the targets alone, without clutter; errors about the truth ``noise_scale`` times as large, and another
    chance of detection where one is given."""
    if noise_scale <= 0:
        raise ValueError("noise_scale must be over 0")
    if detection_probability is not None and not 0 <= detection_probability <= 1:
        raise ValueError("detection_probability must be between 0 and 1")
    if detection_probability is not None:
        radars = tuple(replace(r, pd=detection_probability, pd_min=min(r.pd_min, detection_probability)) for r in radars)
    real = all(r.realistic for r in radars)
    found = (simulate_realistic(gt, radars, seed, 0, 0) if real else simulate(gt, radars, seed)).filter("not is_clutter")
    if noise_scale == 1.0:
        return found
    late = F.coalesce(*(F.when(F.col("sensor") == r.name, r.latency) for r in radars))
    names, axes = found.columns, ["x", "y", "z", "vx", "vy", "vz"]
    whose = lambda df, c: df.withColumn("__key", F.concat_ws("/", "scenario", c))
    truth = whose(gt, "callsign").select("__key", F.col("time").alias("__time"), *(F.col(c).alias(f"true_{c}") for c in axes))
    beside = interpolation_join(whose(found, "callsign_true").withColumn("__time", F.col("time") - late), truth, "__key", "__time", [f"true_{c}" for c in axes], edge="clamp")
    scaled = {c: F.col(f"true_{c}") + noise_scale * (F.col(c) - F.col(f"true_{c}")) for c in axes} | {c: noise_scale * F.col(c) for c in ("sigma_pos_m", "sigma_vel_mps")}
    return beside.withColumns(scaled).select(*names)


def add_target(sensor: DataFrame, target: DataFrame, callsign: str) -> DataFrame:
    """``sensor`` with the measurements of one target replaced by ``target``, moved to each radar's nearest scan, one for a
    scan; the other rows stay as they are."""
    base = sensor.filter(~F.col("callsign_true").eqNullSafe(F.lit(callsign)))
    keyed = lambda df: df.withColumn("__key", F.concat_ws("/", "scenario", "sensor"))
    moved = realigned(keyed(target), keyed(base).filter("time is not null"), "__key", "time", ["callsign_true"], ["ord"])
    return base.unionByName(moved.drop("__key"))


def separations(track: DataFrame, others: DataFrame, within: tuple[str, ...] = (), who: tuple[str, ...] = ()) -> DataFrame:
    """``within, who, callsign, min_distance``: least distance of each track (of the columns ``who``, one track where there are none) to
    each other target of its ``within`` at its own times."""
    place = F.struct(*who, F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"))
    if who:
        return _least_distances(track.groupBy(*within, "time").agg(F.collect_list(place).alias("at")), others, within, who)
    return _least_distances(track.select(*within, "time", F.array(place).alias("at")), others, within, who)


def _least_distances(asked: DataFrame, others: DataFrame, within: tuple[str, ...], who: tuple[str, ...]) -> DataFrame:
    """Of tracks whose places ``at`` a time (``who, px, py, pz``) are one row: a target is asked for once at each time, not for each track."""
    parts = others.select(*within, "callsign").distinct()
    named = lambda df: df.withColumn("__key", F.concat_ws("/", *within, "callsign"))
    ask = named(asked.join(parts, list(within)) if within else asked.crossJoin(parts))
    near = interpolation_join(ask, named(others).select("__key", "time", "x", "y", "z"), "__key", "time", ["x", "y", "z"], edge="drop")
    near = near.select(*within, "callsign", "x", "y", "z", F.inline("at"))
    d = F.sqrt(F.pow(F.col("x") - F.col("px"), 2) + F.pow(F.col("y") - F.col("py"), 2) + F.pow(F.col("z") - F.col("pz"), 2))
    return near.groupBy(*within, *who, "callsign").agg(F.min(d).alias("min_distance"))


def candidate_spirals(p: Spiral) -> list[Spiral]:
    """As given, its centre moved by 50 km along an axis, 3 km higher, turning the other way."""
    (x, y), far = p.centre, 50_000.0
    return [p, *(replace(p, centre=c) for c in ((x + far, y), (x - far, y), (x, y + far), (x, y - far))), replace(p, z0=p.z0 + 3000.0), replace(p, direction=-p.direction)]


def _candidate_points(spark: SparkSession, callsign: str, specs: list[Spiral]) -> DataFrame:
    """Points of spirals around no place, ``candidate`` by ``candidate``."""
    points = None
    for k, spec in enumerate(specs):
        own = spiral_route(spark, "", callsign, spec).drop("scenario").withColumn("candidate", F.lit(k))
        points = own if points is None else points.unionByName(own)
    return points


#: So many points are made in a task.
MADE = 250_000


def _tasks(centres: DataFrame, each: int) -> int:
    """Tasks to deal ``centres`` to that make ``each`` points of a row. They are few small rows, which Spark would leave in one task."""
    return max(1, math.ceil(centres.count() * each / MADE))


def spirals(centres: DataFrame, callsign: str, p: Spiral = Spiral(), least: float | None = None, others: DataFrame | None = None) -> DataFrame:
    """A spiral around the centre ``cx, cy`` of each scenario. With ``least``, the first of seven candidates that keeps so far from
    every target of ``others`` in its scenario; a scenario in which none does has no spiral. Scenarios are rows: a spiral's
    points are made once, sent to all tasks and moved to each."""
    home, centres = replace(p, centre=(0.0, 0.0)), settled(centres.select("scenario", "cx", "cy"), "centres")
    points = _candidate_points(centres.sparkSession, callsign, candidate_spirals(home) if least is not None else [home])
    chosen = centres.withColumn("candidate", F.lit(0)) if least is None else centres.join(_first_free(centres, candidate_distances(centres, others, p), p, least), "scenario")
    moved = chosen.repartition(_tasks(centres, p.points())).join(F.broadcast(points), "candidate")
    return moved.withColumns({"x": F.col("x") + F.col("cx"), "y": F.col("y") + F.col("cy")}).drop("candidate", "cx", "cy")


def candidate_distances(centres: DataFrame, others: DataFrame, p: Spiral) -> DataFrame:
    """``scenario, candidate, callsign, min_distance`` of the candidate spirals. They share their times, at which their places are one row."""
    points = _candidate_points(centres.sparkSession, "", candidate_spirals(replace(p, centre=(0.0, 0.0))))
    at = points.groupBy("time").agg(F.collect_list(F.struct("candidate", "x", "y", "z")).alias("at"))
    moved = F.transform("at", lambda a: F.struct(a["candidate"].alias("candidate"), (a["x"] + F.col("cx")).alias("px"), (a["y"] + F.col("cy")).alias("py"), a["z"].alias("pz")))
    dealt = centres.select("scenario", "cx", "cy").repartition(_tasks(centres, p.points() * len(candidate_spirals(p))))
    asked = dealt.crossJoin(F.broadcast(at)).select("scenario", "time", moved.alias("at"))
    return _least_distances(asked, others, ("scenario",), ("candidate",))


def _first_free(centres: DataFrame, distances: DataFrame, p: Spiral, least: float) -> DataFrame:
    """``scenario, candidate``: the first candidate that keeps ``least`` from all."""
    near = distances.filter(F.col("min_distance") < least).select("scenario", "candidate").distinct()
    free = centres.select("scenario", F.explode(F.array(*(F.lit(k) for k in range(len(candidate_spirals(p)))))).alias("candidate")).join(near, ["scenario", "candidate"], "left_anti")
    return free.groupBy("scenario").agg(F.min("candidate").alias("candidate"))


def spiral_separations(centres: DataFrame, others: DataFrame, p: Spiral, least: float) -> DataFrame:
    """``scenario, callsign, min_distance``: :func:`separations` of the spirals that :func:`spirals` takes, from the distances by which it takes them."""
    distances = settled(candidate_distances(centres, others, p), "candidate-distances")
    return distances.join(_first_free(centres, distances, p, least), ["scenario", "candidate"]).select("scenario", "callsign", "min_distance")


def separated_spiral(spark: SparkSession, scenario: str, callsign: str, others: DataFrame, p: Spiral = Spiral(), least: float = 1000.0) -> DataFrame:
    """The first of the candidate spirals that keeps ``least`` m from every target of ``others``."""
    for spec in candidate_spirals(p):
        route = spiral_route(spark, scenario, callsign, spec)
        nearest = separations(route, others).agg(F.min("min_distance")).first()[0]
        if nearest is None or nearest >= least:
            return route
    raise ValueError(f"no spiral keeps {least} m from the other targets")
