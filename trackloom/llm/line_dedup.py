"""Incremental line deduplication: exact reference-count tables behind sharded cuckoo filters.

A line's key is a 128-bit hash of the line, stripped of ASCII blanks and lower-cased in A-Z. The reference-count table
holds, for every key, the number of documents it occurs in; inserting documents adds to it and deleting documents
subtracts, so deletion restores the state as if they had never come. Keys that reach the threshold enter the cuckoo filter
of their shard, keys that fall below it leave the filter again (which a Bloom filter cannot do).

To drop lines, the keys of all lines meet the filter of their shard: a negative is certain, and only the positives are
joined with the exact table. Filters stay in their shards at any size; a shard has SHARD_KEYS keys at most, and where they
get more, the number of shards doubles. A shard's lines are dealt over as many cells as the texts' bytes ask for, so a very
common line is in no cell more often than the cell has documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.common import Scratch, mix64, utf8

BLANKS = b" \t\n\x0b\x0c\r"
SLOTS = 4
SALTS = 16
SHARD_KEYS = 1_000_000
CELL_BYTES = 12 << 20
COUNTS = "h1 long, h2 long, n_docs long"
FILTERS = pa.schema([("shard", pa.int32()), ("keys", pa.int64()), ("slots", pa.binary())])
FILTERS_SQL = "shard int, keys long, slots binary"


class CuckooFilter:
    """Four 16-bit fingerprints to a bucket; partial-key cuckoo hashing, with bulk operations in numpy."""

    def __init__(self, capacity: int):
        self.mask = (1 << max(2, int(np.ceil(np.log2(max(1, capacity) / (SLOTS * 0.8))))) ) - 1
        self.slots = np.zeros((self.mask + 1, SLOTS), np.uint16)

    def _places(self, h1: np.ndarray, h2: np.ndarray):
        mark = (h2.astype(np.uint64) >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        first = (h1.astype(np.uint64) & np.uint64(self.mask)).astype(np.int64)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (mix64(mark.astype(np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        mark, a, b = self._places(h1, h2)
        return ((self.slots[a] == mark[:, None]) | (self.slots[b] == mark[:, None])).any(1)

    def insert(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Keys must be distinct and not yet inside. Raises OverflowError when a key finds no place."""
        mark, a, b = self._places(h1, h2)
        rest = np.arange(len(mark))
        for bucket in (a, b):  # all that fit beside what is there, at once
            rest = rest[np.argsort(bucket[rest], kind="stable")]
            own = bucket[rest]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else own
            rank = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
            fits = rank < (self.slots[own] == 0).sum(1)
            free = np.argsort(self.slots[own[fits]] != 0, axis=1, kind="stable")
            self.slots[own[fits], free[np.arange(len(free)), rank[fits]]] = mark[rest[fits]]
            rest = rest[~fits]
        for k in rest.tolist():
            if not self._place(int(mark[k]), int(a[k]), int(b[k])):
                raise OverflowError("cuckoo filter is full")

    def _place(self, mark: int, a: int, b: int) -> bool:
        for bucket in (a, b):
            free = np.flatnonzero(self.slots[bucket] == 0)
            if len(free):
                self.slots[bucket, free[0]] = mark
                return True
        bucket = a
        for k in range(500):
            slot = k % SLOTS
            mark, self.slots[bucket, slot] = int(self.slots[bucket, slot]), mark
            bucket = int(self._other(np.array([bucket]), np.array([mark], np.uint16))[0])
            free = np.flatnonzero(self.slots[bucket] == 0)
            if len(free):
                self.slots[bucket, free[0]] = mark
                return True
        return False

    def delete(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Keys must be inside."""
        mark, a, b = self._places(h1, h2)
        for m, x, y in zip(mark.tolist(), a.tolist(), b.tolist()):
            bucket = x if (self.slots[x] == m).any() else y
            self.slots[bucket, np.flatnonzero(self.slots[bucket] == m)[0]] = 0

    @classmethod
    def of(cls, slots: bytes) -> CuckooFilter:
        made = cls(1)
        made.slots = np.frombuffer(slots, np.uint16).reshape(-1, SLOTS).copy()
        made.mask = len(made.slots) - 1
        return made

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> CuckooFilter:
        capacity = len(h1)
        while True:
            made = cls(capacity)
            try:
                made.insert(h1, h2)
                return made
            except OverflowError:
                capacity = 2 * capacity + 8


def line_keys(data: bytes) -> tuple[list[bytes], np.ndarray]:
    """Lines of a text and their keys as rows (h1, h2); the key of an empty stripped line is (0, 0)."""
    import xxhash

    lines = data.split(b"\n")
    digest = xxhash.xxh3_128_digest
    raw = b"".join([digest(k) if k else bytes(16) for k in [x.strip(BLANKS).lower() for x in lines]])
    return lines, np.frombuffer(raw, "<i8").reshape(-1, 2)


def _lists(keys: list[np.ndarray]) -> pa.Array:
    """Rows of (h1, h2) as one flat list of longs each."""
    ends = np.cumsum([0, *(k.size for k in keys)])
    flat = np.concatenate([k.reshape(-1) for k in keys]) if keys else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def _distinct_keys(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys with the number of this batch's documents that hold them: a very common line leaves a batch once."""
    for batch in rows:
        found = []
        for data in batch.column(0).to_pylist():
            keys = np.unique(line_keys(data)[1], axis=0) if b"\n" in data else line_keys(data)[1]
            found.append(keys[(keys != 0).any(1)])
        if not found:
            continue
        keys, counts = np.unique(np.concatenate(found), axis=0, return_counts=True)
        for k in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 100_000, 0]), pa.array(keys[k : k + 100_000, 1]), pa.array(counts[k : k + 100_000].astype(np.int64))], names=["h1", "h2", "n_docs"])


def count_lines(docs: DataFrame) -> DataFrame:
    """``h1, h2, n_docs``: every key of one code point or more with the number of rows of ``docs`` it occurs in."""
    found = docs.select(utf8("text").alias("data")).mapInArrow(_distinct_keys, COUNTS)
    return found.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"))


def _shard(shards: int):
    return F.pmod(F.shiftrightunsigned("h1", 40), F.lit(shards)).cast("int")


def _filter_row(shard: int, keys: int, made: CuckooFilter | None) -> pa.Table:
    return pa.table([[shard], [keys], [None if made is None else made.slots.tobytes()]], schema=FILTERS)


def _build_shard(group: pa.Table) -> pa.Table:
    h1, h2 = group.column("h1").to_numpy(), group.column("h2").to_numpy()
    return _filter_row(group.column("shard")[0].as_py(), len(h1), CuckooFilter.build(h1, h2))


def _change_shard(have: pa.Table, change: pa.Table) -> pa.Table:
    """A shard's filter with the keys that left deleted and those that entered inserted; without slots if it overflows."""
    shard = (have if have.num_rows else change).column("shard")[0].as_py()
    if not change.num_rows:
        return have.select(FILTERS.names).cast(FILTERS)
    h1, h2, enters = (change.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "enters"))
    if not have.num_rows:
        return _filter_row(shard, int(enters.sum()), CuckooFilter.build(h1[enters], h2[enters]))
    made = CuckooFilter.of(have.column("slots")[0].as_py())
    keys = have.column("keys")[0].as_py() + int(enters.sum()) - int((~enters).sum())
    try:
        made.delete(h1[~enters], h2[~enters])
        made.insert(h1[enters], h2[enters])
    except OverflowError:
        made = None
    return _filter_row(shard, keys, made)


PROBE = pa.schema([("shard", pa.int32()), ("salt", pa.int32()), *((c, pa.binary()) for c in ("k1", "k2", "at", "h1", "h2"))])
PROBE_SQL = "shard int, salt int, k1 binary, k2 binary, at binary, h1 binary, h2 binary"
POSITIVE = pa.schema([(c, pa.int64()) for c in ("k1", "k2", "at", "h1", "h2")])


def _asked(shards: int, salts: int):
    """(k1, k2, data) -> the keys of all lines, a row for each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [line_keys(x)[1] for x in batch.column(2).to_pylist()]
            if not own:
                continue
            lengths, keys = np.array([len(x) for x in own]), np.concatenate(own)
            columns = [np.repeat(batch.column(k).to_numpy(), lengths) for k in range(2)]
            columns += [np.concatenate([np.arange(n) for n in lengths.tolist()]), keys[:, 0], keys[:, 1]]
            real = (keys != 0).any(1)
            columns = [c[real] for c in columns]
            cell = ((columns[3].view(np.uint64) >> np.uint64(40)) % np.uint64(shards)).astype(np.int64) * salts + np.mod(columns[0], salts)
            order = np.argsort(cell, kind="stable")
            groups = np.split(order, np.flatnonzero(np.diff(cell[order])) + 1) if len(order) else []
            at = np.array([cell[g[0]] for g in groups], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at // salts).astype(np.int32)), pa.array((at % salts).astype(np.int32)), *(pa.array([c[g].tobytes() for g in groups], pa.binary()) for c in columns)], schema=PROBE)

    return run


def _positives(asked: pa.Table, held: pa.Table) -> pa.Table:
    if not asked.num_rows or not held.num_rows:
        return POSITIVE.empty_table()
    columns = [np.frombuffer(b"".join(asked.column(c).to_pylist()), np.int64) for c in POSITIVE.names]
    hit = CuckooFilter.of(held.column("slots")[0].as_py()).contains(columns[3], columns[4])
    return pa.table([c[hit] for c in columns], schema=POSITIVE)


class LineStore:
    """State of incremental line dedup: the exact reference counts, and the sharded filters of keys at the threshold."""

    def __init__(self, spark: SparkSession, min_docs: int = 10, shards: int = 16, shard_keys: int = SHARD_KEYS):
        self.spark, self.min_docs, self.shards, self.shard_keys = spark, min_docs, shards, shard_keys
        self.scratch, self.version = Scratch(spark, "lines"), 0
        self.counts = spark.createDataFrame([], COUNTS)
        self.filters = spark.createDataFrame([], FILTERS_SQL)

    def insert(self, docs: DataFrame) -> LineStore:
        return self._change(count_lines(docs), 1)

    def delete(self, docs: DataFrame) -> LineStore:
        """Take back documents that were inserted earlier."""
        return self._change(count_lines(docs), -1)

    def _change(self, delta: DataFrame, sign: int) -> LineStore:
        """Adds to the counts, and changes the filters by the keys that came to the threshold or fell below it."""
        self.version += 1
        was = self.counts.select("h1", "h2", F.col("n_docs").alias("was"), F.lit(0).cast("long").alias("by"))
        both = was.union(delta.select("h1", "h2", F.lit(0).cast("long"), (sign * F.col("n_docs")))).groupBy("h1", "h2").agg(F.sum("was").alias("was"), F.sum("by").alias("by"))
        both = self.scratch.save(both.select("h1", "h2", "was", (F.col("was") + F.col("by")).alias("n_docs")).filter("was > 0 or n_docs > 0"), f"counts-{self.version}")
        self.counts = both.filter("n_docs > 0").select("h1", "h2", "n_docs")
        enters, leaves = (F.col("was") < self.min_docs) & (F.col("n_docs") >= self.min_docs), (F.col("was") >= self.min_docs) & (F.col("n_docs") < self.min_docs)
        changes = both.filter(enters | leaves).select("h1", "h2", enters.alias("enters"))
        number, shards = self.dropped().count(), self.shards
        while number > self.shards * self.shard_keys:
            self.shards *= 2
        if self.shards == shards:
            changed = self.filters.groupBy("shard").cogroup(changes.withColumn("shard", _shard(shards)).groupBy("shard")).applyInArrow(_change_shard, FILTERS_SQL)
            changed = self.scratch.save(changed, f"changed-{self.version}")
            full = changed.filter("slots is null").select("shard")
            again = self.dropped().withColumn("shard", _shard(shards)).join(full, "shard").groupBy("shard").applyInArrow(_build_shard, FILTERS_SQL)
            filters = changed.filter("slots is not null").union(again)
        else:  # keys have other shards now
            filters = self.dropped().withColumn("shard", _shard(self.shards)).groupBy("shard").applyInArrow(_build_shard, FILTERS_SQL)
        self.filters = self.scratch.save(filters, f"filters-{self.version}")
        return self

    def dropped(self) -> DataFrame:
        return self.counts.filter(F.col("n_docs") >= self.min_docs).select("h1", "h2")

    def apply(self, docs: DataFrame, cell_bytes: int = CELL_BYTES) -> DataFrame:
        """``doc_id, n_lines, n_dropped, kept (binary)`` for each row of ``docs``.

        A null or empty text is one empty line. Empty keys are never dropped. Repeated rows and null doc_ids get a row
        each; very long texts are lines like others. Other columns are ignored.
        """
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("data"))
        # rows of equal id and text have equal results, so (id, hash of text) is key enough for what follows
        rows = rows.select("doc_id", F.xxhash64("doc_id", "data").alias("k1"), F.xxhash64("data", "doc_id").alias("k2"), "data")
        size = rows.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]
        salts = int(max(1, -(-size // (cell_bytes * self.shards))))
        asked = rows.select("k1", "k2", "data").mapInArrow(_asked(self.shards, salts), PROBE_SQL)
        held = self.filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        asked = asked.groupBy("shard", "salt").cogroup(held.groupBy("shard", "salt")).applyInArrow(_positives, "k1 long, k2 long, at long, h1 long, h2 long")
        # a very common line is dealt over SALTS tasks; the dropped keys, far fewer than the lines, are repeated for that
        asked = asked.withColumn("salt", F.pmod(F.col("k1"), F.lit(SALTS)).cast("int"))
        exact = self.dropped().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        drops = asked.join(exact, ["h1", "h2", "salt"]).groupBy("k1", "k2").agg(F.collect_set("at").alias("at"))

        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lines, dropped, texts = [], [], []
                for data, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    own = data.split(b"\n")
                    gone = set(at or ())
                    lines.append(len(own))
                    dropped.append(len(gone))
                    texts.append(b"\n".join([x for k, x in enumerate(own) if k not in gone]) if gone else data)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.binary())], names=["doc_id", "n_lines", "n_dropped", "kept"])

        joined = rows.join(drops, ["k1", "k2"], "left").select("doc_id", "data", "at")
        return joined.mapInArrow(kept, "doc_id long, n_lines long, n_dropped long, kept binary")


def digest(applied: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of :meth:`LineStore.apply`."""
    return applied.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
