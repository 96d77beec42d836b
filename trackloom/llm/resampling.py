"""Importance resampling towards a target distribution: hashed n-gram weights, Gumbel keys, an external merge of sorted runs.

Two passes over the texts: one counts hashed n-grams, a vector of buckets for each task; the other scores every document by
an array of bucket gains and writes what it scored as sorted runs, cut into packed blocks. The rest handles blocks, about a
hundredth of the texts. Marks of the runs give boundaries of key ranges, exact counts of the ranges give each its first
rank, and every range that the draw reaches is merged from its slices of all runs by a tournament tree, which stops at the
exact count. Keys (score, doc_id, run, place) are all different, so no number of ties or repeated rows makes a range large.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import Scratch, utf8, word_lists

#: Bytes of words stay, A-Z in lower case; all others are blanks. Bytes from 0x80 belong to non-ASCII characters.
WORD_BYTES = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
WORDS_AT_ONCE = 1 << 16
RUN_ROWS = 1 << 16
BLOCK_ROWS = 4096
MARKS = 1 << 18
LAST = np.iinfo(np.int64).max

PAYLOAD = ("ids", "n_features", "weights", "scores")
BLOCKS_SQL = "run long, start long, eligible boolean, " + ", ".join(f"{c} array<long>" for c in PAYLOAD)
BLOCKS = pa.schema([("run", pa.int64()), ("start", pa.int64()), ("eligible", pa.bool_()), *((c, pa.list_(pa.int64())) for c in PAYLOAD)])
RANKED_SQL = "doc_id long, n_features long, weight long, score long, rank long"
RANKED = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_features", "weight", "score", "rank")])


@dataclass(frozen=True)
class Settings:
    """``buckets`` of hashed n-grams of 1 to 3 words; documents of ``least_words`` or more are eligible, and ``percent`` of
    them, rounded down, are drawn. A range of keys has about ``range_rows`` documents, or the share of the draw that gives
    ``ranges`` of them where that is more."""

    buckets: int = 10_000
    least_words: int = 20
    percent: int = 5
    seed: int = 42
    range_rows: int = 4096
    ranges: int = 4096


def features(data: bytes, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the n-grams that end in them) for stretches of a text. The checksum of an n-gram goes on from that
    of the n-gram without its last word."""
    carry = []
    for new in word_lists(data.translate(WORD_BYTES), WORDS_AT_ONCE):
        words, old = carry + new, len(carry)
        one = list(map(crc32, words))
        spaced = [b" " + w for w in words]
        two = list(map(crc32, spaced[1:], one))
        three = list(map(crc32, spaced[2:], two))
        found = one[old:] + two[max(0, old - 1) :] + three[max(0, old - 2) :]
        yield len(new), np.array(found, np.int64) % buckets
        carry = words[-2:]


def bucket_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """Occurrences of hashed n-grams in ``text`` by bucket. A task hands on a count for each bucket it has met."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, found in features(text.as_py(), buckets):
                    total += np.bincount(found, minlength=buckets)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["bucket", "n"])

    found = rows.select(utf8("text").alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    table = found.toArrow()  # a row for each bucket at most
    counts = np.zeros(buckets, np.int64)
    counts[table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of target to source share of each bucket, one added to every count, rounded down."""
    up = (target + 1).astype(np.float64) * np.float64(source.sum() + len(source))
    down = (source + 1).astype(np.float64) * np.float64(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log(x)) for x in (up / down).tolist()], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Thousandths of a standard Gumbel draw that depends on (seed, doc_id) alone; a null doc_id is an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def runs(docs: DataFrame, gain: np.ndarray, s: Settings) -> DataFrame:
    """Packed blocks of scored documents: the eligible ones of a task in runs by descending score and ascending doc_id (null
    last), ``start`` being a block's place in its run; the others in blocks of their own."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, part, made = sent.value, TaskContext.get().partitionId(), 0
        held: dict[bool, list[tuple]] = {True: [], False: []}

        def blocks(eligible: bool) -> Iterator[pa.RecordBatch]:
            nonlocal made
            rows, held[eligible] = held[eligible], []
            if eligible:
                rows.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
            run, made = (part << 32) + made, made + 1
            for at in range(0, len(rows), BLOCK_ROWS):
                own = list(zip(*rows[at : at + BLOCK_ROWS]))
                yield pa.RecordBatch.from_arrays([pa.array([run]), pa.array([at]), pa.array([eligible]), *(pa.array([list(x)], pa.list_(pa.int64())) for x in own)], schema=BLOCKS)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                n_words = n_features = weight = 0
                for n, found in features(text.as_py(), len(gain)):
                    n_words, n_features, weight = n_words + n, n_features + len(found), weight + int(gain[found].sum())
                eligible = n_words >= s.least_words
                held[eligible].append((doc_id, n_features, weight, weight + noise(doc_id, s.seed)))
                if len(held[eligible]) == RUN_ROWS:
                    yield from blocks(eligible)
        yield from blocks(True)
        yield from blocks(False)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text")).mapInArrow(score, BLOCKS_SQL)


Key = tuple[int, int, int, int]


def boundaries(blocks: DataFrame, rows: int) -> list[Key]:
    """Keys that cut the eligible documents into ranges of about ``rows``, from marks at every sixteenth of the blocks; of
    more than MARKS marks a share by hash. They settle only how the merge is dealt out, never what is drawn."""
    n = F.size("ids")
    places = F.sequence(F.lit(0), n - 1, F.greatest(F.ceil(n / 16).cast("int"), F.lit(1)))
    mark = F.transform(places, lambda i: F.struct((-F.get("scores", i)).alias("a"), F.coalesce(F.get("ids", i), F.lit(LAST)).alias("b"), "run", (F.col("start") + i).alias("at"), (n / F.size(places)).alias("w")))
    thin = max(1, -(-blocks.count() * 16 // MARKS))
    found = blocks.filter(F.pmod(F.xxhash64("run", "start"), F.lit(thin)) == 0).select(F.inline(mark)).collect()
    cuts, passed = [], 0.0
    for m in sorted(found):
        if passed >= rows:
            cuts.append((m.a, m.b, m.run, m.at))
            passed = 0.0
        passed += m.w * thin
    return cuts


def slices(blocks: DataFrame, cuts: list[Key]) -> DataFrame:
    """Blocks cut at the boundaries: ``range``, and a block's columns for the part of it in that range."""
    sent = blocks.sparkSession.sparkContext.broadcast(cuts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                key = lambda i, r=row: (-r["scores"][i], LAST if r["ids"][i] is None else r["ids"][i], r["run"], r["start"] + i)
                n, at = len(row["ids"]), 0
                for k in range(bisect_right(sent.value, key(0)), len(sent.value) + 1):
                    to = bisect_left(range(n), sent.value[k], key=key) if k < len(sent.value) else n
                    if to > at:
                        yield pa.RecordBatch.from_pylist([row | {"range": k, "start": row["start"] + at} | {c: row[c][at:to] for c in PAYLOAD}], schema=BLOCKS.append(pa.field("range", pa.int64())))
                    at = to
                    if at == n:
                        break

    return blocks.mapInArrow(cut, BLOCKS_SQL + ", range long")


class Tournament:
    """A tree of losers over sorted runs: ``pop`` gives the least key of all, after as many comparisons as the tree is high.
    A run is an iterator of (key, value), its keys ascending."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, k = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.losers = [0] * k
        won = [0] * k + list(range(k))
        for at in range(k - 1, 0, -1):
            won[at], self.losers[at] = self._match(won[2 * at], won[2 * at + 1])
        self.winner = won[1] if k > 1 else 0

    def _match(self, a: int, b: int) -> tuple[int, int]:
        x, y = self.heads[a], self.heads[b]
        return (a, b) if y is None or x is not None and x[0] <= y[0] else (b, a)

    def pop(self) -> tuple | None:
        if not self.runs or (out := self.heads[self.winner]) is None:
            return None
        on = self.winner
        self.heads[on] = next(self.runs[on], None)
        at = (on + len(self.runs)) // 2
        while at:
            on, self.losers[at] = self._match(on, self.losers[at])
            at //= 2
        self.winner = on
        return out


def merge(found: pa.Table, before: dict[int, int], draw: int) -> pa.Table:
    """The documents of one range, ranked from ``before[range] + 1`` until ``draw`` are ranked; the rest without a rank."""
    rows: dict[int, list[dict]] = {}
    for row in found.sort_by([("run", "ascending"), ("start", "ascending")]).to_pylist():
        rows.setdefault(row["run"], []).append(row)

    def run(parts: list[dict]) -> Iterator[tuple]:
        for p in parts:
            for i, (doc_id, n, weight, score) in enumerate(zip(*(p[c] for c in PAYLOAD))):
                yield (-score, LAST if doc_id is None else doc_id, p["run"], p["start"] + i), (doc_id, n, weight, score)

    tree = Tournament([run(parts) for parts in rows.values()])
    rank, out = before[found.column("range")[0].as_py()], []
    while rank < draw and (top := tree.pop()):
        rank += 1
        out.append((*top[1], rank))
    for head, left in zip(tree.heads, tree.runs):  # what has not been played for
        out += [(*x[1], None) for x in ([head, *left] if head else [])]
    return pa.table([pa.array(x, pa.int64()) for x in zip(*out)], schema=RANKED)


def resample(docs: DataFrame, target: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` for each row of ``docs``: importance weights of its hashed n-grams, how
    often the texts of ``target`` have them against how often ``docs`` has them, and the rank of those drawn.

    Ties go to the smaller doc_id, a null one last, then to either. Repeated rows are scored alike, and each is drawn for
    itself. A null or empty text has no features, weighs 0 and is never drawn. Very long texts are read in stretches; other
    columns are ignored; with an empty ``docs`` the result is empty; an empty ``target`` weighs by rarity alone.
    """
    scratch = Scratch(docs.sparkSession, "resampling")
    gain = gains(bucket_counts(docs, s.buckets), bucket_counts(target, s.buckets))
    blocks = scratch.save(runs(docs, gain, s), "blocks")
    eligible = blocks.filter("eligible")
    n = eligible.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("n")).first().n
    draw = s.percent * n // 100
    cut = scratch.save(slices(eligible, boundaries(eligible, max(s.range_rows, -(-draw // s.ranges)))), "slices")
    before, passed = {}, 0
    for r in cut.groupBy("range").agg(F.sum(F.size("ids")).alias("n")).orderBy("range").collect():  # a row for each range
        if passed < draw:
            before[r.range] = passed
        passed += r.n
    last = max(before, default=-1)
    drawn = cut.filter(F.col("range") <= last).groupBy("range").applyInArrow(lambda t: merge(t, before, draw), RANKED_SQL)
    rest = cut.filter(F.col("range") > last).select(*PAYLOAD).union(blocks.filter("NOT eligible").select(*PAYLOAD))
    rest = rest.select(F.inline(F.arrays_zip(*PAYLOAD))).toDF("doc_id", "n_features", "weight", "score")
    return drawn.union(rest.withColumn("rank", F.lit(None).cast("long")))


def select(docs: DataFrame, target: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The drawn rows of ``docs``, all columns kept. doc_ids must be there and different; rows of a null doc_id go."""
    drawn = resample(docs, target, s).filter("rank IS NOT NULL").select(F.col("doc_id").alias("__drawn"))
    held = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("__drawn"))
    return held.join(drawn, "__drawn", "left_semi").select("row.*")
