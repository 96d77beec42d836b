"""N-gram Jaccard self-join by universe-partition pigeonhole, and the groups its links form.

A document's set is its distinct word shingles. Sets that link at threshold t differ in H elements at most, H by the sizes
of the band. The universe is hashed into m segments of the band; ``y`` of them also index their one-deletion neighbourhoods
and so tolerate one difference. With m + y = H + 1 + slack, linked sets share more than ``slack`` exact segments or one of
the neighbourhoods, so each document may leave ``slack`` exact segments unindexed:

- up to ``light`` nearly empty ones, whose signatures would match almost everything, by a cost model of the band;
- its ``crowd`` most crowded ones by the measured number of documents under each signature. Two documents rank the segments
  they share alike, so what either leaves out of those is ``crowd`` of them at most.

Buckets of up to PAIRS documents give pairs, larger ones meet in cells of two blocks. A pair is passed over if the parity
sketches of its sets (the parity of the elements hashed to each bit; sketches differ in no more bits than the sets in
elements) prove it unlinked. Of the others a forest is verified exactly, word by word, then what could still join two of
its trees, until no untested pair can. Copies of one set are one node, numbered by 64 bits of the hash of the set.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import Scratch, mix64, sieve, utf8

NULL_ID = 2**63 - 1
RATIO = 1.3
LIGHT = 2
CROWD = 0.2
PAIRS = 16
BLOCK = 2048
FIRST = 8
TASK_ROWS = 1 << 17
HEAVY = 8
SALTS = 16
DELETION = 128
PART_BYTES = 8 << 20
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)


def shingles(data: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text: words are lower-cased in A-Z and split at ASCII blanks; with
    fewer words than ``width`` the whole sequence is one shingle, without words there is none."""
    import xxhash

    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(width, len(words))
    total = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        total = mix64(total + h[k : k + len(total)] * np.uint64(MULTIPLIERS[k % 7]))
    return np.unique(total)


@lru_cache(4096)
def band(size: int) -> tuple[int, int, int]:
    """(number, smallest, largest size) of the band of a size; bands grow by RATIO."""
    k, low = 0, 1
    while True:
        high = max(low, math.ceil(low * RATIO) - 1)
        if size <= high:
            return k, low, high
        k, low = k + 1, high + 1


@lru_cache(4096)
def allocation(high: int, percent: int) -> tuple[int, int, int, int]:
    """(segments, of them with one deletion, light, crowd) of the band of sizes up to ``high`` at the least cost; no segments
    where only equal sets link. Cost: signatures of a set, and ``weight`` candidates for each signature of an exact
    segment of up to LIGHT elements that has to be given, as likely as a Poisson share says. What can't be known from sizes,
    the crowded signatures, is left to ``crowd`` and the measured counts."""
    differ = high * (100 - percent) // percent
    if differ == 0:
        return 0, 0, 0, 0
    crowd, weight, best = int(CROWD * differ), 40.0, None
    for y in range(0, min(differ + 2, 7)):
        for slack in range(0, y + 1):
            m = differ + 1 + slack + crowd - y
            if m < max(y, 1):
                continue
            mean = high / (m + y)
            light = math.exp(-mean) * sum(mean**i / math.factorial(i) for i in range(LIGHT + 1)) * (m - y)
            over = 1 - math.exp(-light) * sum(light**i / math.factorial(i) for i in range(slack + 1)) if light < 500 else 1.0
            two = 2 * mean
            empty = y * math.exp(-two) * (1 + two)
            cost = m - y + y * (1 + two) + weight * (light * over + empty)
            if best is None or cost < best[0]:
                best = (cost, m, y, slack)
    return *best[1:], crowd


def signatures(elements: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct signatures of a set, one set of them for each band that a partner of its size or less can be in, and each
    one's band, with DELETION added where a segment has one-deletion neighbourhoods."""
    size, out, kinds = len(elements), [], []
    low = -(-size * percent // 100)
    while size:
        k, first, last = band(low)
        m, y, slack, _ = allocation(last, percent)
        if m:
            slot = (mix64(elements ^ np.uint64(MULTIPLIERS[3])) % np.uint64(m + y)).astype(np.int64)
            segment = np.where(slot < 2 * y, slot // 2, slot - y)
            order = np.argsort(segment, kind="stable")
            seg, values = segment[order], mix64(elements[order])
            counts = np.bincount(seg, minlength=m)
            sums = np.zeros(m, np.uint64)
            filled = np.flatnonzero(counts)
            sums[filled] = np.add.reduceat(values, np.concatenate([[0], np.cumsum(counts[filled])[:-1]]))
            salt = mix64(np.arange(m, dtype=np.uint64) + np.uint64((k + 1) << 32))
            light = np.flatnonzero((counts <= LIGHT) & (np.arange(m) >= y))
            given = np.ones(m, bool)
            if len(light) <= slack:
                given[light] = False
            out.append(mix64(sums[given] + salt[given]))
            kinds.append(np.where(np.arange(m) < y, k + DELETION, k)[given])
            if y:
                own = seg < y
                out.append(mix64(sums[seg[own]] - values[own] + salt[seg[own]]))
                kinds.append(np.full(len(out[-1]), k + DELETION))
        if last >= size:
            break
        low = last + 1
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.uint8)
    found, at = np.unique(np.concatenate(out), return_index=True)
    return found.view(np.int64), np.concatenate(kinds)[at].astype(np.uint8)


def sketch(elements: np.ndarray) -> np.ndarray:
    """Parities of the elements under each of 64 or more bits, twice the elements or more; a power of two, so that larger
    sketches fold to the size of smaller ones."""
    bits = max(64, 1 << (2 * len(elements) - 1).bit_length())
    odd = np.bincount((mix64(elements) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(words: np.ndarray, size: int) -> np.ndarray:
    while len(words) > size:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def node_of(elements: np.ndarray) -> int:
    import xxhash

    return int.from_bytes(xxhash.xxh3_128_digest(elements.tobytes())[:8], "little", signed=True)


#: A signature goes by five of its bytes and its part. Parts under 0 hold whole numbers of signatures.
RECORDS = pa.schema([("part", pa.int64()), ("sigs", pa.binary()), ("nids", pa.binary()), ("kinds", pa.binary())])
TOLD = pa.schema([("did", pa.int64()), ("tag", pa.int64()), ("n", pa.int64()), ("nid", pa.int64()), ("sketch", pa.binary())])
SIG_BYTES = 5


def _describe(width: int, percent: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            n, nid, made = [], [], []
            for data in batch.column(2).to_pylist():
                s = shingles(data, width)
                n.append(len(s))
                nid.append(node_of(s))
                made.append(sketch(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(nid, pa.int64()), pa.array(made, pa.binary())], schema=TOLD)

    return run


def _records(part: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each part, of the columns' bytes in their order."""
    if len(part):
        order = np.argsort(part, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(part[order])) + 1)
        arrays = [pa.array([x[g].tobytes() for g in groups], pa.binary()) for x in columns]
        yield pa.RecordBatch.from_arrays([pa.array([int(part[g[0]]) for g in groups], pa.int64()), *arrays], schema=RECORDS)


def _sign(width: int, percent: int, parts: int):
    def dealt(sigs: list[np.ndarray], nids: list[np.ndarray], kinds: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        sig, nid, kind = np.concatenate(sigs), np.concatenate(nids), np.concatenate(kinds)
        part = ((sig.view(np.uint64) >> np.uint64(8 * SIG_BYTES)) % np.uint64(parts)).astype(np.int64)
        # a signature of many nodes goes on as rows dealt by node; two of them tell its part that it is shared
        order = np.argsort(sig, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(sig[order]) != 0])) if len(sig) else order
        size = np.diff(np.append(first, len(sig)))
        rank = np.arange(len(sig)) - np.repeat(first, size)
        heavy = np.empty(len(sig), bool)
        heavy[order] = np.repeat(size >= HEAVY, size) & (rank >= 2)
        low = sig.view(np.uint8).reshape(-1, 8)[:, :SIG_BYTES]
        yield from _records(part[~heavy], low[~heavy], nid[~heavy], kind[~heavy])
        yield from _records(-1 - nid[heavy] % parts, _short(sig[heavy], parts), nid[heavy], kind[heavy])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = set(), 0  # of one task's nodes each goes on once
        sigs, nids, kinds = [], [], []
        for batch in rows:
            for data in batch.column(0):
                s = shingles(data.as_py(), width)
                if not len(s) or (node := node_of(s)) in seen:
                    continue
                seen.add(node)
                sig, kind = signatures(s, percent)
                sigs.append(sig)
                kinds.append(kind)
                nids.append(np.full(len(sig), node))
                held += len(sig)
                if held >= 1 << 19:
                    yield from dealt(sigs, nids, kinds)
                    sigs, nids, kinds, held = [], [], [], 0
        if sigs:
            yield from dealt(sigs, nids, kinds)

    return run


def _short(sig: np.ndarray, parts: int) -> np.ndarray:
    """The number that a signature goes by: five bytes and the part."""
    u = sig.view(np.uint64)
    return ((u & np.uint64((1 << 8 * SIG_BYTES) - 1)) | ((u >> np.uint64(8 * SIG_BYTES)) % np.uint64(parts)) << np.uint64(8 * SIG_BYTES)).view(np.int64)


SHARED = pa.schema([("sig", pa.int64()), ("nid", pa.int64()), ("kind", pa.int32())])


def _shared(group: pa.Table) -> pa.Table:
    """Signatures that two nodes or more have."""
    part = group.column("part")[0].as_py()
    joined = lambda c, t: np.frombuffer(b"".join(group.column(c).to_pylist()), t)
    nid, kind = joined("nids", np.int64), joined("kinds", np.uint8)
    if part < 0:
        sig = joined("sigs", np.int64)
    else:
        wide = np.zeros((len(nid), 8), np.uint8)
        wide[:, :SIG_BYTES] = joined("sigs", np.uint8).reshape(-1, SIG_BYTES)
        sig = wide.view(np.int64).reshape(-1) | np.int64(part << 8 * SIG_BYTES)
        order = np.lexsort((nid, sig))
        sig, nid, kind = sig[order], nid[order], kind[order]
        new = np.ones(len(sig), bool)
        new[1:] = (np.diff(sig) != 0) | (np.diff(nid) != 0)
        sig, nid, kind = sig[new], nid[new], kind[new]
        same = np.diff(sig) == 0
        keep = np.zeros(len(sig), bool)
        keep[1:] |= same
        keep[:-1] |= same
        sig, nid, kind = sig[keep], nid[keep], kind[keep]
    return pa.table({"sig": sig, "nid": nid, "kind": kind.astype(np.int32)}, schema=SHARED)


def _whole_runs(rows: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole runs of rows with equal first ``keys`` columns, from rows in their order."""
    held: list[pa.RecordBatch] = []
    for batch in rows:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in range(keys):
            x = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= x[1:] != x[:-1]
            change[0] |= bool(held) and x[0] != held[-1].column(k)[-1].as_py()
        cut = np.flatnonzero(change)
        if len(cut):
            held.append(batch.slice(0, int(cut[-1])))
            yield pa.Table.from_batches(held)
            held = [batch.slice(int(cut[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _small_pairs(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sig, nid) in the order of sig -> distinct pairs of each bucket."""
    for table in _whole_runs(rows, 1):
        sig, nid = table.column(0).to_numpy(), table.column(1).to_numpy()
        out = []
        for step in range(1, PAIRS):
            at = np.flatnonzero(sig[step:] == sig[:-step])
            if not len(at):
                break
            out.append(np.stack([np.minimum(nid[at], nid[at + step]), np.maximum(nid[at], nid[at + step])], 1))
        pairs = np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _cells(percent: int, every: bool):
    """(sig, i, j, nid, n, root, sketch) in the order of cells -> pairs (a, b) of different roots that sketches let pass:
    all of them, or a forest over the roots."""

    def search(n: np.ndarray, root: np.ndarray, bits: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        def near(k: int, others: np.ndarray) -> np.ndarray:
            d = np.bitwise_count(bits[others] ^ bits[k]).sum(1, dtype=np.int64)
            return others[(d * (100 + percent) <= (n[others] + n[k]) * (100 - percent)) & (root[others] != root[k])]

        if every:
            for k in range(len(n) - 1):
                yield k, near(k, np.arange(k + 1, len(n)))
            return
        left, queue = np.ones(len(n), bool), []
        for first in range(len(n)):
            if left[first]:
                own = np.flatnonzero(left & (root == root[first]))
                left[own] = False
                queue += own.tolist()
            while queue:
                k = queue.pop()
                others = np.flatnonzero(left)
                if not len(others):
                    return
                found = near(k, others)
                if len(found):
                    found = found[np.unique(root[found], return_index=True)[1]]
                    yield k, found
                    own = np.flatnonzero(left & np.isin(root, root[found]))
                    left[own] = False
                    queue += own.tolist()

    def told(pairs: dict | set) -> pa.RecordBatch:
        ends = [x[-2:] for x in (pairs.values() if isinstance(pairs, dict) else pairs)]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in ends], pa.int64()) for k in range(2)], names=["a", "b"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task's cells share most of their members: each pair leaves it once, and of a forest each larger root's best
        every_pair, best = set(), {}
        for table in _whole_runs(rows, 3):
            keys = np.stack([table.column(k).to_numpy() for k in range(3)], 1)
            nid, n, root = (table.column(k).to_numpy() for k in (3, 4, 5))
            data = table.column(6).to_pylist()
            cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if b - a > 1 and (root[a:b] != root[a]).any():
                    size = min(len(x) for x in data[a:b]) // 8
                    bits = np.stack([folded(np.frombuffer(x, np.uint64), size) for x in data[a:b]])
                    ids, roots = nid[a:b].tolist(), root[a:b].tolist()
                    for k, found in search(n[a:b], root[a:b], bits):
                        for f in found.tolist():
                            pair = (min(ids[k], ids[f]), max(ids[k], ids[f]))
                            if every:
                                every_pair.add(pair)
                            else:
                                hi, one = max(roots[k], roots[f]), (min(roots[k], roots[f]), *pair)
                                best[hi] = min(best.get(hi, one), one)
                if len(every_pair) + len(best) >= 1 << 19:
                    yield told(every_pair if every else best)
                    every_pair, best = set(), {}
        yield told(every_pair if every else best)

    return run


def _passed(percent: int):
    """(a, b, na, nb, sketch of a, of b) -> (a, b) that sketches let pass."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            keep = []
            columns = [batch.column(k).to_pylist() for k in range(2, 6)]
            for k, (na, nb, x, y) in enumerate(zip(*columns)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                size = min(len(x), len(y))
                d = int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum(dtype=np.int64))
                if d * (100 + percent) <= (na + nb) * (100 - percent):
                    keep.append(k)
            keep = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])

    return run


def shingle_set(data: bytes, width: int) -> set:
    words = data.lower().split()
    n = min(width, len(words))
    return set(zip(*(words[k : len(words) - n + 1 + k] for k in range(n)))) if n else set()


def _verify(width: int, percent: int):
    """Streams (pivot, nid, data) rows, each pivot's own before its members; gives the pairs that link, word by word."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, set()
        for batch in rows:
            left, right = [], []
            for pivot, nid, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if nid == pivot:
                    if at != pivot:
                        at, own = pivot, shingle_set(data, width)
                    continue
                other = shingle_set(data, width)
                both = len(own & other) if at == pivot else 0
                if 100 * both >= percent * (len(own) + len(other) - both):
                    left.append(pivot)
                    right.append(nid)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def connected(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``node, root`` for every node of ``edges`` (a, b): the smallest node of its component, by alternating large and
    small stars until a round changes no edge; edges are saved between rounds, and a common neighbour is a join key that
    may be split."""
    step, now = 0, edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = scratch.save(now, f"{name}-0")
    state = lambda rows: rows.agg(F.count("*"), *(F.bit_xor(F.xxhash64(F.lit(k), "u", "v")) for k in range(2))).first()  # noqa: E731  of a set of edges
    last = state(now)
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # each node keeps its smallest neighbour and hands it to the others
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        step += 1
        now = scratch.save(small, f"{name}-{step}")
        before, last = last, state(now)
        if last == before:
            break
    roots = now.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").union(roots.select(F.col("root").alias("node"), "root").distinct())


def components(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """``did, tag, n, component, root`` for each row of ``docs``: ``did`` is the doc_id, NULL_ID for null, ``tag`` a hash of
    the text, ``root`` the number of its group.

    Sets link when 100 * intersection >= percent * union. Empty sets link with nothing. Copies, null ids and repeated rows
    keep a row each; very long texts have more segments, not larger ones; other columns are ignored.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "jaccard")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did"), utf8("text").alias("data")).withColumn("tag", F.xxhash64("data"))
    told = scratch.save(texts.select("did", "tag", "data").mapInArrow(_describe(width, percent), "did long, tag long, n long, nid long, sketch binary"), "told")
    parts = int(max(16, -(-texts.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0] // PART_BYTES)))
    signed = texts.select("data").mapInArrow(_sign(width, percent, parts), "part long, sigs binary, nids binary, kinds binary")
    shared = scratch.save(signed.groupBy("part").applyInArrow(_shared, "sig long, nid long, kind int"), "shared").distinct()

    # each document leaves out its most crowded signatures
    crowds = F.array(*(F.lit(c) for c in _crowds(percent)))
    sizes = shared.groupBy("sig").agg(F.count("*").alias("size"))
    ranked = shared.join(sizes, "sig").withColumn("rank", F.row_number().over(Window.partitionBy("nid", "kind").orderBy(F.desc("size"), "sig")))
    kept = ranked.filter((F.col("kind") >= DELETION) | (F.col("rank") > F.get(crowds, F.col("kind"))))
    kept = scratch.save(kept.filter("size > 1").select("sig", "nid", "size"), "kept")
    nodes = told.filter("n > 0").groupBy("nid").agg(F.min(F.struct("did", "tag")).alias("own"), F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch"))
    nodes = scratch.save(nodes.join(kept.select("nid").distinct(), "nid"), "nodes")

    small = kept.filter(F.col("size") <= PAIRS).select("sig", "nid").repartition("sig").sortWithinPartitions("sig").mapInArrow(_small_pairs, "a long, b long").distinct()
    side = lambda c: nodes.select(F.col("nid").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    both = small.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb")
    small = scratch.save(both.mapInArrow(_passed(percent), "a long, b long"), "pairs")

    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("nid"), F.col("blocks")).cast("int")
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k != F.col("own")))
    large = kept.filter(F.col("size") > PAIRS).withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(others))
    large = large.select("sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "nid")

    def candidates(roots: DataFrame | None, every: bool) -> DataFrame:
        """``a, b, ra, rb``: pairs of different roots, all of them or enough to connect what they connect. Without roots yet,
        from one in FIRST of the large buckets: near copies share many, and what they leave comes with the roots."""
        cells = large.filter(F.pmod(F.xxhash64("sig"), F.lit(FIRST)) == 0).withColumn("root", F.col("nid"))
        pairs = small.select("a", "b", F.col("a").alias("ra"), F.col("b").alias("rb"))
        deal = [F.col("sig"), F.col("i"), F.col("j")]
        if roots is not None:
            cells = large.join(roots, F.col("nid") == F.col("node"), "left").select(*large.columns, F.coalesce("root", "nid").alias("root"))
            live = cells.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("rows")).filter("lo < hi")
            # buckets of one tree hold much the same nodes: they go to few tasks, each of which tells a pair once
            tasks = live.groupBy("lo").agg(F.ceil(F.sum("rows") / TASK_ROWS).alias("tasks"))
            live = live.join(tasks, "lo").select("sig", "lo", F.pmod(F.xxhash64("sig"), F.col("tasks")).alias("task"))
            cells, pairs, deal = cells.join(live, "sig"), _rooted(small, roots), [F.col("lo"), F.col("task")]
        cells = cells.join(nodes.select("nid", "n", "sketch"), "nid").select("sig", "i", "j", "nid", "n", "root", "sketch", *(c for c in deal if roots is not None))
        cells = cells.repartition(*deal).sortWithinPartitions("sig", "i", "j", "nid").select("sig", "i", "j", "nid", "n", "root", "sketch")
        more = cells.mapInArrow(_cells(percent, every), "a long, b long").distinct()
        more = _rooted(more, roots) if roots is not None else more.select("a", "b", F.col("a").alias("ra"), F.col("b").alias("rb"))
        return pairs.filter("ra <> rb").union(more)

    def forest(pairs: DataFrame) -> DataFrame:
        """For each larger root its pair with the smallest lesser one."""
        ends = pairs.select(F.greatest("ra", "rb").alias("hi"), F.least("ra", "rb").alias("lo"), "a", "b")
        return ends.groupBy("hi").agg(F.min(F.struct("lo", "a", "b")).alias("x")).select("x.a", "x.b")

    def pick(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:  # a doc_id and tag given to several texts: the node's own is the one with its set
            nid, data = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = pa.array([k for k in range(len(data)) if node_of(shingles(data[k], width)) == nid[k]], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["nid", "data"])

    def fetched(todo: DataFrame, have: DataFrame | None, name: str) -> DataFrame:
        """``nid, data`` of the nodes of some pairs, one document's text for each, beside those that are there already."""
        ends = todo.select(F.col("a").alias("nid")).union(todo.select("b")).distinct()
        ends = ends if have is None else ends.join(have.select("nid"), "nid", "left_anti")
        wanted = scratch.save(nodes.join(ends, "nid").select("nid", "own.did", "own.tag"), f"wanted-{name}")
        if have is not None and not wanted.limit(1).count():
            return have
        found = sieve(texts, wanted, ["did", "tag"]).join(wanted, ["did", "tag"]).select("nid", "data")
        found = scratch.save(found.mapInArrow(pick, "nid long, data binary"), f"texts-{name}")
        return found if have is None else have.union(found)

    def verified(todo: DataFrame, data: DataFrame, name: str) -> DataFrame:
        salted = todo.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
        members = salted.join(data.withColumnRenamed("nid", "b"), "b").select("a", "salt", "b", "data")
        pivots = salted.select("a", "salt").distinct().join(data.withColumnRenamed("nid", "a"), "a").select("a", "salt", F.col("a").alias("b"), "data")
        rows = members.union(pivots).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b") != F.col("a"))
        return scratch.save(rows.select("a", "b", "data").mapInArrow(_verify(width, percent), "a long, b long").distinct(), name)

    tested = scratch.save(forest(scratch.save(candidates(None, False), "pool")), "tested-0")
    data = fetched(tested, None, "0")
    links = verified(tested, data, "links-0")
    roots = scratch.save(connected(links, scratch, "star-0"), "roots-0")
    for turn in (1, 2):  # once more a forest, over the trees found; then every pair that could still join two of them
        open_ = scratch.save(candidates(roots, turn == 2).join(tested, ["a", "b"], "left_anti"), f"open-{turn}")
        if not open_.limit(1).count():
            if turn == 2:
                break
            continue
        todo = scratch.save(forest(open_) if turn == 1 else open_.select("a", "b").distinct(), f"tested-{turn}")
        data = fetched(todo, data, str(turn))
        more = verified(todo, data, f"links-{turn}")
        tested = tested.union(todo)
        if more.limit(1).count():
            links = links.union(more)
            roots = scratch.save(connected(links, scratch, f"star-{turn}"), f"roots-{turn}")
    rows = told.filter("n > 0").join(roots, F.col("nid") == F.col("node"), "left").select("did", "tag", "n", F.coalesce("root", "nid").alias("root"))
    rows = scratch.save(rows, "rooted")
    filled = rows.join(rows.groupBy("root").agg(F.min("did").alias("component")), "root").select("did", "tag", "n", "component", "root")
    return filled.union(told.filter("n = 0").select("did", "tag", "n", F.col("did").alias("component"), F.lit(None).cast("long").alias("root")))


def _rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """``a, b`` with their roots."""
    for c in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")), c, "left").withColumn(f"r{c}", F.coalesce(f"r{c}", c))
    return pairs.select("a", "b", "ra", "rb")


@lru_cache(8)
def _crowds(percent: int) -> list[int]:
    """``crowd`` of every band of up to DELETION bands."""
    out, low = [], 1
    while len(out) < DELETION:
        _, _, high = band(low)
        out.append(allocation(high, percent)[3])
        low = high + 1
    return out


def report(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id, n_shingles, component_id``. Rows with a null doc_id take part in links; a component of nothing else has a
    null id. A null, empty or blank text has no shingle; very long texts and rows repeated are as in :func:`components`;
    columns of any other name are ignored."""
    real = lambda c: F.when(F.col(c) == NULL_ID, None).otherwise(F.col(c))
    return components(docs, width, percent).select(real("did").alias("doc_id"), F.col("n").alias("n_shingles"), real("component").alias("component_id"))


def keep_one(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """``docs`` with one document of each group, that of the smallest doc_id (then hash of the text), null last; documents
    without words all stay, as do all columns, whatever their names. Of rows repeated with doc_id and text one stays."""
    scratch = Scratch(docs.sparkSession, "keep")
    found = scratch.save(components(docs, width, percent).filter("n > 0"), "found")
    first = found.groupBy("root").agg(F.min(F.struct("did", "tag")).alias("first"))
    rows = found.groupBy("root", "did", "tag").agg(F.count("*").alias("times")).join(first, "root")
    leads = (F.col("did") == F.col("first.did")) & (F.col("tag") == F.col("first.tag"))
    # documents that go, and those of which repeated rows go; all others stay as they are and meet nothing
    judged = scratch.save(rows.select("did", "tag", leads.alias("leads"), "times").filter("not leads or times > 1"), "judged")
    held = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did"), F.xxhash64(utf8("text")).alias("tag"))
    maybe = sieve(held, judged, ["did", "tag"]).join(judged, ["did", "tag"], "left")
    once = maybe.filter("leads").dropDuplicates(["did", "tag"]).select("row").union(maybe.filter("leads is null").select("row"))
    return sieve(held, judged, ["did", "tag"], out=True).select("row").union(once).select("row.*")
