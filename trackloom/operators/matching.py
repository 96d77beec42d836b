"""Assignment of tracks to targets in frames that do not depend on each other: many frames are solved at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = 1 << 21
PAIRS = "array<struct<i:int,j:int>>"


def assign_stack(cost: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The column of each row (-1 for none) in the least-cost assignment of every matrix of a stack (frames, n, m).

    ``rows`` of a frame are real, the rest padding; padded columns cost infinity, and a frame has as many real columns as
    rows at least. Rows join one after the other by a shortest augmenting path, in step over all frames that are not done.
    """
    size, n, m = cost.shape
    u, v = np.zeros((size, n + 1)), np.zeros((size, m + 1))
    owner = np.zeros((size, m + 1), np.int64)
    for i in range(1, n + 1):
        own = np.flatnonzero(rows >= i)
        if not len(own):
            break
        at, way = np.zeros(len(own), np.int64), np.zeros((len(own), m + 1), np.int64)
        least, used = np.full((len(own), m + 1), np.inf), np.zeros((len(own), m + 1), bool)
        owner[own, 0] = i
        live = np.arange(len(own))
        while len(live):
            f = own[live]
            used[live, at[live]] = True
            row = owner[f, at[live]]
            now = cost[f, row - 1] - u[f, row][:, None] - v[f, 1:]
            done, short, back = used[live], least[live], way[live]
            better = ~done[:, 1:] & (now < short[:, 1:])
            short[:, 1:] = np.where(better, now, short[:, 1:])
            back[:, 1:] = np.where(better, at[live][:, None], back[:, 1:])
            to = np.where(done, np.inf, short).argmin(1)
            step = short[np.arange(len(live)), to]
            k, j = np.nonzero(done)  # different rows own the columns of a frame
            u[f[k], owner[f[k], j]] += step[k]
            v[f] -= np.where(done, step[:, None], 0.0)
            least[live], way[live], at[live] = np.where(done, short, short - step[:, None]), back, to
            live = live[owner[f, to] != 0]
        live = np.arange(len(own))
        while len(live):
            back = way[live, at[live]]
            owner[own[live], at[live]] = owner[own[live], back]
            at[live] = back
            live = live[back != 0]
    out = np.full((size, n), -1)
    k, j = np.nonzero(owner[:, 1:])
    out[k, owner[k, j + 1] - 1] = j
    return out


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(frame, tracks, targets) with places as lists of three -> (frame, pairs)."""
    for batch in batches:
        a, b = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        sizes = [(len(x), len(y)) for x, y in zip(a, b)]
        pairs: list = [None] * len(a)
        kinds: dict[tuple[int, int], list[int]] = {}
        for k, s in enumerate(sizes):  # frames of one power of two are padded to the largest of them
            kinds.setdefault((max(s).bit_length(), min(s).bit_length()), []).append(k)
        for same in kinds.values():
            n, m = max(min(sizes[k]) for k in same), max(max(sizes[k]) for k in same)
            for at in range(0, len(same), max(1, CELLS // (n * m))):
                own = same[at : at + max(1, CELLS // (n * m))]
                places = np.zeros((2, len(own), m, 3))
                real = np.zeros((2, len(own), m), bool)
                for i, k in enumerate(own):  # the smaller side is the rows
                    for side, some in enumerate(sorted((a[k], b[k]), key=len) if sizes[k][0] != sizes[k][1] else (a[k], b[k])):
                        places[side, i, : len(some)], real[side, i, : len(some)] = some, True
                cost = np.sqrt(((places[0][:, :n, None] - places[1][:, None]) ** 2).sum(-1))
                cost = np.where(real[1][:, None], cost, np.inf)
                for k, found in zip(own, assign_stack(cost, real[0][:, :n].sum(1)).tolist()):
                    ends = [(i, j) for i, j in enumerate(found) if j >= 0]
                    pairs[k] = [{"i": i, "j": j} if sizes[k][0] <= sizes[k][1] else {"i": j, "j": i} for i, j in ends]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pairs, pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32())])))], names=["frame", "pairs"])


def matched(a: np.ndarray, frame_a: np.ndarray, b: np.ndarray, frame_b: np.ndarray, gate: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b`` of the pairs within the gate, from the least-distance assignment of each frame. Places (n, 3) are in
    order of their frames; frames of one size are solved as a stack."""
    size = 1 + max(frame_a.max(initial=-1), frame_b.max(initial=-1))
    na, nb = np.bincount(frame_a, minlength=size), np.bincount(frame_b, minlength=size)
    at_a, at_b = np.cumsum(na) - na, np.cumsum(nb) - nb
    both = np.flatnonzero((na > 0) & (nb > 0))
    found_a, found_b = [np.zeros(0, int)], [np.zeros(0, int)]
    kinds, of = np.unique(np.stack([na[both], nb[both]], 1), axis=0, return_inverse=True)
    for kind, (n, m) in enumerate(kinds.tolist()):
        same = both[of.ravel() == kind]
        for at in range(0, len(same), max(1, CELLS // (n * m))):
            own = same[at : at + max(1, CELLS // (n * m))]
            i, j = at_a[own][:, None] + np.arange(n), at_b[own][:, None] + np.arange(m)
            cost = np.sqrt(((a[i][:, :, None] - b[j][:, None]) ** 2).sum(-1))
            if min(n, m) == 1:  # the nearest, the first of equals
                k = cost.reshape(len(own), -1).argmin(1)
                rows, cols = k[:, None] // m, k[:, None] % m
            elif n <= m:
                rows, cols = np.broadcast_to(np.arange(n), (len(own), n)), assign_stack(cost, np.full(len(own), n))
            else:
                rows, cols = assign_stack(np.swapaxes(cost, 1, 2), np.full(len(own), m)), np.broadcast_to(np.arange(m), (len(own), m))
            near = np.take_along_axis(cost.reshape(len(own), -1), rows * m + cols, 1) <= gate
            found_a.append(np.take_along_axis(i, rows, 1)[near])
            found_b.append(np.take_along_axis(j, cols, 1)[near])
    return np.concatenate(found_a), np.concatenate(found_b)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(sum(F.pow(a[c] - b[c], 2) for c in "xyz"))


def frames_assigned(tracks: DataFrame, targets: DataFrame, frame: list[str], track: str, target: str, gate: float, keep: tuple[tuple[str, ...], tuple[str, ...]] = ((), ())) -> DataFrame:
    """``frame, a, b, pairs, lost_a, lost_b``: a row for each frame, its tracks and targets (``id, x, y, z`` and the columns ``keep`` of
    each side), the pairs within the gate (``i, j, d``: places in ``a`` and ``b``, and distance), and the ids without a finite place."""
    every = sorted({c for own in keep for c in own} - set("xyz"))

    def side(df: DataFrame, name: str, k: int) -> DataFrame:
        rest = [F.col(c).cast("double").alias(c) if c in keep[k] else F.lit(None).cast("double").alias(c) for c in every]
        ids = [(F.col(name) if n == k else F.lit(None).cast(kind)).alias(f"id_{s}") for n, (s, kind) in enumerate(kinds)]
        return df.select(*frame, *ids, *(F.col(c).cast("double").alias(c) for c in "xyz"), *rest, F.lit(k).alias("side"))

    kinds = [("a", tracks.schema[track].dataType), ("b", targets.schema[target].dataType)]
    rows = side(tracks, track, 0).union(side(targets, target, 1))
    finite = F.lit(True)
    for c in "xyz":
        finite = finite & F.coalesce(F.abs(c) < float("inf"), F.lit(False))
    whose = [[c for c in own if c not in "xyz"] for own in keep]
    held = lambda k: F.array_sort(F.collect_list(F.when(finite & (F.col("side") == k), F.struct(F.col(f"id_{kinds[k][0]}").alias("id"), "x", "y", "z", *whose[k]))))
    none = lambda k: F.collect_list(F.when(~finite & (F.col("side") == k), F.col(f"id_{kinds[k][0]}")))
    frames = rows.groupBy(*frame).agg(held(0).alias("a"), held(1).alias("b"), none(0).alias("lost_a"), none(1).alias("lost_b"))

    nearest = lambda one, many: F.array_min(F.transform(many, lambda x, k: F.struct(distance(F.get(one, F.lit(0)), x).alias("d"), k.alias("k"))))["k"]
    pair = lambda i, j: F.array(F.struct(i.cast("int").alias("i"), j.cast("int").alias("j")))
    na, nb, zero = F.size("a"), F.size("b"), F.lit(0)
    easy = F.when((na == 0) | (nb == 0), F.array().cast(PAIRS)).when(na == 1, pair(zero, nearest(F.col("a"), F.col("b")))).otherwise(pair(nearest(F.col("b"), F.col("a")), zero))
    small = frames.filter(F.least(na, nb) <= 1).withColumn("pairs", easy)
    places = lambda c: F.transform(c, lambda x: F.array(x["x"], x["y"], x["z"]))
    whole = F.struct(*frames.columns).alias("frame")
    hard = frames.filter(F.least(na, nb) > 1).select(whole, places("a").alias("a"), places("b").alias("b"))
    kind = frames.select(whole).schema["frame"].dataType.simpleString()
    hard = hard.mapInArrow(_solve, f"frame {kind}, pairs {PAIRS}").select("frame.*", "pairs")

    told = F.transform("pairs", lambda p: F.struct(p["i"].alias("i"), p["j"].alias("j"), distance(F.get("a", p["i"]), F.get("b", p["j"])).alias("d")))
    return small.unionByName(hard).withColumn("pairs", F.filter(told, lambda p: p["d"] <= gate))


def unmatched(side: str, k: str) -> Column:
    """What of ``a`` or ``b`` is in no pair; ``k`` is the side's place in a pair."""
    return F.filter(side, lambda x, n: ~F.exists("pairs", lambda p: p[k] == n))


def assigned(tracks: DataFrame, targets: DataFrame, frame: list[str], track: str, target: str, gate: float) -> DataFrame:
    """``frame, track, target, distance``: the assignment of least total distance between the tracks and the targets of each
    frame; then pairs farther apart than ``gate`` are parted. A pair has both ids, a false track no target, a missed target no
    track. Both sides have columns ``x, y, z``; what has no finite place matches nothing. Frames with one track or one
    target are settled by the nearest, all others in stacks of many frames; a frame meets in one row.
    """
    found = frames_assigned(tracks, targets, frame, track, target, gate)
    row = lambda a, b, d: F.struct(a.alias("a"), b.alias("b"), d.alias("d"))
    far, kind = F.lit(None).cast("double"), {c: found.schema[f"lost_{c}"].dataType.elementType for c in "ab"}
    left = lambda c, k: F.concat(F.transform(unmatched(c, k), lambda x: x["id"]), f"lost_{c}")
    every = F.concat(
        F.transform("pairs", lambda p: row(F.get("a", p["i"])["id"], F.get("b", p["j"])["id"], p["d"])), F.transform(left("a", "i"), lambda x: row(x, F.lit(None).cast(kind["b"]), far)), F.transform(left("b", "j"), lambda x: row(F.lit(None).cast(kind["a"]), x, far))
    )
    return found.select(*frame, F.inline(every)).toDF(*frame, track, target, "distance")
