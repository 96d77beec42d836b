"""Exact top-k search over binary codes by multi-index hashing.

Vectors become sign bits. A code is cut into segments of some log2(codes) bits, each with an index of its own. A query
probes, in every segment, all values within radius r, verifies the codes found, and grows r until the k-th verified
distance is covered: a code at distance d differs by at most d // m in one of the m segments, so after radius r every code
nearer than m * (r + 1) has been seen. Equal codes are indexed once, with as many of their smallest ids as an answer can
hold. The queries are dealt over blocks, and the index over shards once it has more than SHARD_CODES codes; each task holds
one shard's index and one block.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_CODES = 500_000
BLOCK_QUERIES = 20_000
LEAST_CELLS = 8


@lru_cache(None)
def masks(width: int, r: int) -> np.ndarray:
    """All values of ``width`` bits of which ``r`` are set."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), r)], np.int64)


def codes(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """``id, code``: one bit for each positive component, padded with zeros to whole 64-bit words, as bytes. Rows with a
    null id or vector have no code; null components count as not positive; very long vectors have long codes; repeated rows
    have a code each; other columns are ignored."""

    def run(batches):
        for batch in batches:
            rows = [np.packbits(np.nan_to_num(np.array(v, np.float64)) > 0, bitorder="little").tobytes() for v in batch.column(1).to_pylist()]
            rows = [r + bytes(-len(r) % 8) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["id", "code"])

    return vectors.select(F.col("vec_id").cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id is not null and v is not null and size(v) > 0").mapInArrow(run, "id long, code binary")


class SegmentIndex:
    """Codes (rows of 64-bit words) under every segment."""

    def __init__(self, words: np.ndarray):
        self.words = words
        bits = 64 * words.shape[1]
        self.segments = -(-bits // min(16, max(4, len(words).bit_length() - 1)))
        self.cuts = np.arange(self.segments + 1) * bits // self.segments
        parts = self._values(words)
        self.order = [np.argsort(p, kind="stable") for p in parts]
        self.starts = [np.concatenate([[0], np.cumsum(np.bincount(p, minlength=1 << w))]) for p, w in zip(parts, np.diff(self.cuts).tolist())]

    def _values(self, words: np.ndarray) -> list[np.ndarray]:
        bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")
        return [bits[:, a:b].astype(np.int64) @ (1 << np.arange(b - a)) for a, b in zip(self.cuts[:-1], self.cuts[1:])]

    def search(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(rows, distances) of all codes as near as the k-th nearest, and the radius that covers them."""
        parts, seen = [int(p[0]) for p in self._values(query[None])], np.zeros(len(self.words), bool)
        widths = np.diff(self.cuts).tolist()
        rows, distances = np.empty(0, np.int64), np.empty(0, np.int64)
        for r in range(max(widths) + 1):
            found = []
            for j, width in enumerate(widths):
                values = parts[j] ^ masks(width, r)
                lo = self.starts[j][values]
                n = self.starts[j][values + 1] - lo
                ends = np.cumsum(n)
                if len(n) and ends[-1]:
                    found.append(self.order[j][np.repeat(lo - ends + n, n) + np.arange(ends[-1])])
            found = np.concatenate(found) if found else np.empty(0, np.int64)
            found = np.unique(found[~seen[found]])
            seen[found] = True
            d = np.bitwise_count(self.words[found] ^ query).sum(1).astype(np.int64)
            rows, distances = np.concatenate([rows, found]), np.concatenate([distances, d])
            kth = np.partition(distances, k - 1)[k - 1] if len(distances) >= k else 1 << 40
            if kth < self.segments * (r + 1):
                break
        near = distances <= kth
        return rows[near], distances[near], r


def _least(rows: DataFrame, by: str, order: list[str], keep: int) -> DataFrame:
    """The first ``keep`` rows of each value; Spark cuts each task's own to as many before it shuffles them."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= keep)


def search(index: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, id, distance``: for every query the ``k`` nearest rows of ``index`` other than itself; ties go to
    the smaller id. ``index`` and ``queries`` are (id, code); an id given twice with one code counts once. With fewer than
    ``k`` others all are returned; an empty index gives an empty result, as does a query whose code has another length than
    all of the index's; codes of several lengths have an index each, and very long ones more segments."""
    keep = k + 1
    kept = _least(index.select("id", "code").distinct(), "code", ["id"], keep)
    distinct = kept.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    asked = queries.select("code").distinct()
    shards, blocks = (max(1, -(-df.count() // n)) for df, n in ((distinct, SHARD_CODES), (asked, BLOCK_QUERIES)))
    # a small index is not split, which would cost its segments bits; a few more blocks give every core some queries
    blocks = max(blocks, -(-LEAST_CELLS // shards))
    cell = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = distinct.select("code", "ids", F.pmod(F.xxhash64("code"), F.lit(shards)).cast("int").alias("shard"), cell(blocks, "block"))
    right = asked.select("code", F.pmod(F.xxhash64("code", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), cell(shards, "shard"))
    schema = "code binary, distance long, id long"

    def run(have: pa.Table, want: pa.Table) -> pa.Table:
        out_codes, out_distances, out_ids = [], [], []
        if have.num_rows and want.num_rows:
            data = have.column("code").to_pylist()
            by_size: dict[int, list[int]] = {}
            for row, code in enumerate(data):
                by_size.setdefault(len(code), []).append(row)
            ids = have.column("ids").to_pylist()
            made = {n: (SegmentIndex(np.frombuffer(b"".join(data[r] for r in rows), "<u8").reshape(len(rows), -1)), rows) for n, rows in by_size.items()}
            for code in want.column("code").to_pylist():
                if len(code) not in made:
                    continue
                index, rows = made[len(code)]
                at, distance, _ = index.search(np.frombuffer(code, "<u8"), keep)
                best = sorted((int(d), i) for r, d in zip(at.tolist(), distance.tolist()) for i in ids[rows[r]])[:keep]
                out_codes += [code] * len(best)
                out_distances += [d for d, _ in best]
                out_ids += [i for _, i in best]
        return pa.table({"code": pa.array(out_codes, pa.binary()), "distance": pa.array(out_distances, pa.int64()), "id": pa.array(out_ids, pa.int64())})

    n = shards * blocks  # given, so that small cells are not put into one task
    dealt = lambda df: df.repartition(n, "shard", "block").groupBy("shard", "block")
    best = _least(dealt(left).cogroup(dealt(right)).applyInArrow(run, schema), "code", ["distance", "id"], keep).drop("rank")
    own = queries.select(F.col("id").alias("query_id"), "code").distinct().join(best, "code").filter("id <> query_id")
    return _least(own, "query_id", ["distance", "id"], k).select("query_id", "rank", "id", "distance")
