"""Time-series joins and windows. Joins align on a key and are one shuffle of both sides: union, then windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _carried(rows: DataFrame, key: str) -> DataFrame:
    """The last sample before each (key, bucket) and the first one after it, as samples of that bucket. Only one row for each
    bucket meets the others of its key."""
    latest = F.when(F.col("__side") == 0, F.struct("__t", "__s"))
    # of samples at the earliest time the largest, as within a bucket
    earliest = F.when(F.col("__side") == 0, F.struct((-F.col("__t")).alias("back"), "__s", "__t"))
    edges = rows.groupBy(key, "__bucket").agg(F.max(latest).alias("last"), F.max(earliest).alias("first"))
    w = Window.partitionBy(key).orderBy("__bucket")
    before = F.last("last", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("first", True).over(w.rowsBetween(1, Window.unboundedFollowing))
    ends = edges.select(key, "__bucket", before.alias("a"), after.alias("b"))
    end = lambda c: F.struct(F.col(f"{c}.__t").alias("t"), F.col(f"{c}.__s").alias("s"))
    both = ends.select(key, "__bucket", F.explode(F.array(end("a"), end("b"))).alias("x"))
    return both.filter("x.t is not null").select(key, "__bucket", F.col("x.t").alias("__t"), F.col("x.s").alias("__s"))


def _aligned(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str], bucket: float | None = None) -> DataFrame:
    """Rows of ``left`` with the nearest rows of ``right`` on both sides as structs ``__before`` and ``__after``. With
    ``bucket``, the width of a time bucket, a key's rows are dealt out by bucket."""
    sample = F.struct(F.col(time).alias("t"), *values)
    empty = F.lit(None).cast(right.select(sample.alias("s")).schema["s"].dataType)
    rows = left.select(key, F.col(time).alias("__t"), F.struct(*left.columns).alias("__row"), empty.alias("__s"), F.lit(1).alias("__side"))
    none = F.lit(None).cast(rows.schema["__row"].dataType)
    samples = right.filter(F.col(time).isNotNull()).select(key, F.col(time).alias("__t"), none.alias("__row"), sample.alias("__s"), F.lit(0).alias("__side"))
    both, keys = rows.unionByName(samples), [key]
    if bucket is not None:
        both, keys = both.withColumn("__bucket", F.floor(F.col("__t") / bucket)), [key, "__bucket"]
        both = both.unionByName(_carried(both, key).withColumns({"__row": none, "__side": F.lit(0)}))
    # one order serves both sides; of samples at one time the largest stands first and the others give way, so that what is
    # beside a row is the same in every run
    w = Window.partitionBy(*keys).orderBy("__t", "__side", F.col("__s").desc())
    again = (F.col("__side") == 0) & F.lag("__t").over(w).eqNullSafe(F.col("__t"))
    both = both.withColumn("__sample", F.when(~again, F.col("__s")))
    both = both.withColumns({"__before": F.last("__sample", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "__next": F.expr("lead(__sample) IGNORE NULLS").over(w)}).filter("__row is not null")
    at, before = F.col("__t"), F.col("__before")
    # a row without a time lies nowhere between samples; a sample at the row's own time is on both its sides
    return both.withColumns({"__before": F.when(at.isNotNull(), before), "__after": F.when(before["t"] == at, before).otherwise(F.when(at.isNotNull(), F.col("__next")))})


def interpolation_join(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str], edge: str = "null", min_rows: int = 1, bucket: float | None = None) -> DataFrame:
    """``left`` with ``values`` of ``right`` interpolated linearly at its times.

    ``bucket``, a width in time that holds what a task should, deals out the rows of a key that has very many: buckets get the
    samples beside them from a scan over one row for each bucket. Results are the same.

    ``edge`` outside the samples: ``null`` keeps the row with nulls, ``clamp`` takes the end sample, ``drop`` leaves the
    row out. With fewer than ``min_rows`` samples of a key, or without a time, values are null. Of samples at one time the
    one of largest values counts.
    """
    found = _aligned(left, right, key, time, values, bucket)
    if min_rows > 1:
        enough = right.groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") >= min_rows).select(key, F.lit(True).alias("__ok"))
        found = found.join(enough, key, "left").withColumns({s: F.when(F.col("__ok"), F.col(s)) for s in ("__before", "__after")})
    a, b, t = F.col("__before"), F.col("__after"), F.col("__t")
    inside = a.isNotNull() & b.isNotNull()
    share = F.when(b["t"] > a["t"], (t - a["t"]) / (b["t"] - a["t"])).otherwise(0.0)
    outer = (lambda v: F.coalesce(a[v], b[v])) if edge == "clamp" else (lambda v: F.lit(None).cast("double"))
    if edge == "drop":
        found = found.filter(inside)
    return found.select("__row.*", *(F.when(inside, a[v] + share * (b[v] - a[v])).otherwise(outer(v)).alias(v) for v in values))


def nearest_join(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str], tolerance: float | None = None, bucket: float | None = None) -> DataFrame:
    """As-of join to the nearest sample in time, the earlier on ties; unmatched rows stay with nulls. ``matched_time`` is
    the sample's. ``bucket`` is as in :func:`interpolation_join`."""
    found = _aligned(left, right, key, time, values, bucket)
    a, b, t = F.col("__before"), F.col("__after"), F.col("__t")
    back = a.isNotNull() & (b.isNull() | (t - a["t"] <= b["t"] - t))
    best = F.when(back, a).otherwise(b)
    near = F.lit(True) if tolerance is None else F.abs(t - best["t"]) <= tolerance
    return found.withColumn("__best", F.when(near, best)).select("__row.*", F.col("__best.t").alias("matched_time"), *(F.col(f"__best.{v}").alias(v) for v in values))


def free(name: str, df: DataFrame) -> str:
    """``name``, longer where ``df`` has a column of it already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ordered(key: str, *by: str) -> Window:
    return Window.partitionBy(key).orderBy(*by)


def difference(c: str, w: Window) -> Column:
    return F.col(c) - F.lag(c).over(w)


def rolling_mean(c: str, w: Window, before: int = 1, after: int = 1) -> Column:
    return F.avg(c).over(w.rowsBetween(-before, after))


def segment_number(time: str, w: Window, gap: float) -> Column:
    """Rises by one where the gap to the row before is over ``gap``."""
    return F.sum(F.when(difference(time, w) > gap, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))


def segments(df: DataFrame, key: str, time: str, gap: float, error: str | None = None) -> DataFrame:
    """``key, segment, start, end, n, duration, max_gap``: runs without a gap over ``gap``; with ``error``, a column, its
    ``mean_error`` and ``max_error`` too."""
    w, step = ordered(key, time), free("__gap", df)
    marked = df.withColumns({step: difference(time, w), "segment": segment_number(time, w, gap)})
    inner = F.when(F.col(step) <= gap, F.col(step))
    errors = [F.avg(error).alias("mean_error"), F.max(error).alias("max_error")] if error else []
    return marked.groupBy(key, "segment").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n"), (F.max(time) - F.min(time)).alias("duration"), F.max(inner).alias("max_gap"), *errors)


def gradient(value: str, time: str, w: Window) -> Column:
    """Second-order differences on uneven steps, one-sided of second order at the ends (three rows at least)."""
    v, t = F.col(value), F.col(time)
    at = lambda c, k: (F.lag(c, -k) if k < 0 else F.lead(c, k)).over(w) if k else c
    p = lambda c, k: F.lag(c, k).over(w)
    hs, hd = t - p(t, 1), at(t, 1) - t
    middle = (hs * hs * at(v, 1) + (hd * hd - hs * hs) * v - hd * hd * p(v, 1)) / (hs * hd * (hd + hs))
    h1, h2 = at(t, 1) - t, at(t, 2) - at(t, 1)
    first = -(2 * h1 + h2) / (h1 * (h1 + h2)) * v + (h1 + h2) / (h1 * h2) * at(v, 1) - h1 / (h2 * (h1 + h2)) * at(v, 2)
    g1, g2 = p(t, 1) - p(t, 2), t - p(t, 1)
    last = g2 / (g1 * (g1 + g2)) * p(v, 2) - (g1 + g2) / (g1 * g2) * p(v, 1) + (2 * g2 + g1) / (g2 * (g1 + g2)) * v
    return F.coalesce(middle, first, last)


def unwrap(angle: str, w: Window) -> Column:
    """Radians without jumps over pi."""
    import math

    d = difference(angle, w)
    turn = F.when(F.abs(d) > math.pi, -2 * math.pi * F.rint(d / (2 * math.pi))).otherwise(0.0)
    return F.col(angle) + F.sum(turn).over(w.rowsBetween(Window.unboundedPreceding, 0))


def affine_scan(df: DataFrame, key: str, order: list[str], factor: str, term: str, start: str, bucket: str, out: str) -> DataFrame:
    """``df`` with ``out``, the value of p -> factor * p + term run down each key's rows from the first row's ``start``.

    Maps compose, so the run is a prefix scan: doubling strides within each ``bucket`` (a column that rises with the order and
    splits a long key), then over one row for each bucket, then both together; no key's rows meet in one task.
    """

    def scanned(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
        """``__a, __b`` of each row composed with those of all rows before it in its group."""
        longest = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first().n
        w, step = Window.partitionBy(*keys).orderBy(*by), 1
        while step < longest:  # lags over one order: neither shuffled nor sorted again
            a, b = F.lag("__a", step).over(w), F.lag("__b", step).over(w)
            rows = rows.withColumns({"__a": F.when(a.isNotNull(), F.col("__a") * a).otherwise(F.col("__a")), "__b": F.when(a.isNotNull(), F.col("__a") * b + F.col("__b")).otherwise(F.col("__b"))})
            step *= 2
        return rows

    held = df.select(key, F.struct(*df.columns).alias("__row"), F.struct(*order).alias("__o"), F.col(bucket).alias("__k"), F.col(factor).alias("__a"), F.col(term).alias("__b"))
    inside = scanned(held, [key, "__k"], ["__o"])
    ends = inside.groupBy(key, "__k").agg(F.max_by(F.struct("__a", "__b"), "__o").alias("m"), F.min(F.struct("__o", F.col(f"__row.{start}").alias("p"))).alias("first")).select(key, "__k", F.col("m.__a").alias("__a"), F.col("m.__b").alias("__b"), "first.p")
    ends = scanned(ends, [key], ["__k"])
    w = Window.partitionBy(key).orderBy("__k")
    first = F.first("p").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    entry = ends.select(key, "__k", F.coalesce(F.lag("__a").over(w) * first + F.lag("__b").over(w), first).alias("__p"))
    return inside.join(entry, [key, "__k"]).select("__row.*", (F.col("__a") * F.col("__p") + F.col("__b")).alias(out))


def id_switches(df: DataFrame, track: str, time: str, target: str) -> DataFrame:
    """``track, switches``: matches whose target differs from the row before; a null target (no match) resets."""
    w = ordered(track, time)
    before = F.lag(target).over(w)
    changed = F.col(target).isNotNull() & before.isNotNull() & (before != F.col(target))
    return df.withColumn("__c", changed.cast("long")).groupBy(track).agg(F.sum("__c").alias("switches"))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w, n = Window.partitionBy(*keys).orderBy(*order), free("__n", df)
    return df.withColumn(n, F.row_number().over(w)).filter(F.col(n) == 1).drop(n)


def last_rows(df: DataFrame, order: list[str], most: int) -> DataFrame:
    """The last ``most`` rows in an order, in that order: a partial top in every task, then one of all."""
    return df.orderBy(*(F.col(c).desc_nulls_last() for c in order)).limit(most).orderBy(*(F.col(c).asc_nulls_first() for c in order))


def histogram(df: DataFrame, value: str, width: float, key: str | None = None) -> DataFrame:
    """``[key,] bin, n`` of all bins between the smallest and the largest, empty ones too. Gaps are filled from each bin to
    the next, so no array is longer than a gap."""
    keys = [key] if key else []
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.floor(F.col(value) / width).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    spans = counted.withColumn("__next", F.coalesce(F.lead("bin", 1).over(Window.partitionBy(*keys).orderBy("bin")) - 1, F.col("bin")))
    spans = spans.withColumn("k", F.explode(F.sequence("bin", "__next")))
    return spans.select(*keys, F.col("k").alias("bin"), F.when(F.col("k") == F.col("bin"), F.col("n")).otherwise(0).alias("n"))


def evenly_picked(df: DataFrame, order: list[str], most: int, key: str) -> DataFrame:
    """Of each key ``most`` rows at equal steps from the first to the last, or all where there are no more."""
    w, last, at = Window.partitionBy(key), free("__last", df), free("__at", df)
    rows = df.withColumns({last: F.count("*").over(w) - 1, at: F.row_number().over(w.orderBy(*order)) - 1})
    # the i-th pick is row floor(i * last / (most - 1)); row k is one if the first i at or past it lands on it
    pick = f"({at} * {most - 1} + {last} - 1) div {last}"
    return rows.filter(f"{last} < {most} or ({pick}) * {last} div {most - 1} = {at}").drop(last, at)


def monotonic_checks(df: DataFrame, key: str, order: str, values: dict[str, str]) -> DataFrame:
    """``key`` and, for each value by its prefix, ``rising`` and ``repeated``: whether it never falls in the order, and how many rows
    repeat an earlier value. All values go in one pass."""
    w = ordered(key, order)
    steps = {p: free(f"__{p}", df) for p in values}
    found = df.withColumns({steps[p]: difference(c, w) for p, c in values.items()})
    return found.groupBy(key).agg(*(x for p, c in values.items() for x in ((F.count_if(F.col(steps[p]) < 0) == 0).alias(f"{p}_rising"), (F.count(c) - F.count_distinct(c)).alias(f"{p}_repeated"))))


def realigned(df: DataFrame, scans: DataFrame, key: str, time: str, who: list[str], order: list[str]) -> DataFrame:
    """``df`` with each time moved to the key's nearest scan, the earlier on ties, and of rows of one (key, time, who) the first
    in order; times of a key without scans stay."""
    names = df.columns
    moved = nearest_join(df, scans.select(key, time).distinct(), key, time, [])
    moved = moved.withColumn("__was", F.col(time)).withColumn(time, F.coalesce("matched_time", time))
    return keep_first(moved, [key, time, *who], ["__was", *order]).select(*names)


def every_kth(df: DataFrame, order: list[str], most: int, key: str) -> DataFrame:
    """Rows 0, k, 2k ... of each key, k the smallest step that leaves ``most`` rows at most."""
    w = Window.partitionBy(key)
    n, at = free("__n", df), free("__at", df)
    rows = df.withColumns({n: F.count("*").over(w), at: F.row_number().over(w.orderBy(*order)) - 1})
    return rows.filter(f"{at} % greatest(1, ceil({n} / {most})) = 0").drop(n, at)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Multiset equality on the columns of ``a``."""
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
