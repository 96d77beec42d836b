"""Audit of how sources of a language differ in their terms, by mergeable radix tries.

A task counts the terms of its texts in a byte trie for each language, whose leaves hold occurrences and documents by source.
Tries leave a task as packed stretches of leaves in UTF-8 order. Marks at the leaves give prefix ranges of even size; the
stretches of a range meet and are merged, ``FAN`` tasks at a time and again until one is left, so a term that every task has
is never gathered at once. A traversal of the merged ranges then streams each leaf's contribution to all pairs of sources and
the candidates of each source, in the order that settles ties. All counts and shares are whole numbers.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Collection, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import Scratch, utf8, word_lists

#: Bytes of terms stay, A-Z in lower case; all others are blanks.
TERM_BYTES = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
TERMS_AT_ONCE = 1 << 18
#: Counters that a trie holds before it sums them, and terms of all its tries before a task lets them go.
HELD, TERMS = 1 << 19, 300_000
LEAVES = 4096
FAN = 64
MARKS = 1 << 18
SALTS = 16
SCALE = 1_000_000_000

STRETCH_SQL = "lang string, part long, names array<string>, terms array<binary>, sizes array<int>, sources array<int>, n array<long>, docs array<long>"
STRETCH = pa.schema(
    [("lang", pa.string()), ("part", pa.int64()), ("names", pa.list_(pa.string())), ("terms", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32())), ("sources", pa.list_(pa.int32())), ("n", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64()))]
)
RANGED = STRETCH.append(pa.field("range", pa.int64()))
FOUND_SQL = "lang string, source string, part string, item string, value long"
FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


@dataclass(frozen=True)
class Settings:
    """A language keeps terms of ``least_docs`` of its documents or more; a source's terms are told to rank ``top``. A prefix
    range has about ``range_leaves`` counters, more where there would be more than ``ranges``."""

    least_docs: int = 3
    top: int = 200
    range_leaves: int = 50_000
    ranges: int = 1 << 14


class RadixTrie:
    """A byte trie of which each edge is the longest stretch without a branch. Leaves are numbered as they come; their counters
    are arrays of (leaf, source, occurrences, documents), summed when the trie goes out."""

    def __init__(self):
        self.root: list = [b"", None, -1]  # an edge's bytes, the nodes below by their first byte, a term's leaf
        self.terms: list[bytes] = []
        self.known: dict[bytes, int] = {}  # a term that has come before need not walk down again
        self.names: dict[str, int] = {}
        self.counters: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def insert(self, term: bytes) -> int:
        """The number of the term's leaf, a new one if it was not there."""
        node, at, end = self.root, 0, len(term)
        while at < end:
            if node[1] is None:
                node[1] = {}
            below = node[1].get(term[at])
            if below is None:
                node[1][term[at]] = node = [term[at:], None, -1]
                break
            edge = below[0]
            if not term.startswith(edge, at):
                same = 1
                while at + same < end and same < len(edge) and edge[same] == term[at + same]:
                    same += 1
                node[1][term[at]] = fork = [edge[:same], {edge[same]: below}, -1]
                below[0], below = edge[same:], fork
            node, at = below, at + len(below[0])
        if node[2] < 0:
            node[2] = len(self.terms)
            self.terms.append(term)
        return node[2]

    def add(self, terms: Collection[bytes], sources: np.ndarray | str, n: np.ndarray, docs: np.ndarray, sizes: np.ndarray | None = None) -> None:
        """Counters of terms: of one source, or ``sizes`` of them for each term by their numbers in ``names``."""
        known = self.known
        for term in set(terms).difference(known):
            known[term] = self.insert(term)
        leaf = np.fromiter(map(known.__getitem__, terms), np.int64, len(terms))
        if sizes is None:
            sources = np.full(len(leaf), self.names.setdefault(sources, len(self.names)))
        else:
            leaf = np.repeat(leaf, sizes)
        self.counters.append((leaf, sources, n, docs))
        self.held += len(leaf)
        if self.held >= max(HELD, len(self.counters[0][0])):  # as many new ones as there are sums already
            self.counters, self.held = [self._summed(*(np.concatenate(x) for x in zip(*self.counters)))], 0

    def _summed(self, leaf: np.ndarray, source: np.ndarray, n: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, ...]:
        key = leaf * len(self.names) + source
        by = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(key[by]) != 0]))
        return *np.divmod(key[by[first]], len(self.names)), np.add.reduceat(n[by], first), np.add.reduceat(docs[by], first)

    def leaves(self) -> Iterator[int]:
        """Leaves in the byte order of their terms."""
        held = [self.root]
        while held:
            _, below, leaf = held.pop()
            if leaf >= 0:
                yield leaf
            if below is not None:
                held += [below[b] for b in sorted(below, reverse=True)]

    def summed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Leaves in order, and the sums of their counters: (place in that order, source, occurrences, documents)."""
        order = np.fromiter(self.leaves(), np.int64, len(self.terms))
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        leaf, *rest = (np.concatenate(x) for x in zip(*self.counters))
        return order, *self._summed(place[leaf], *rest)

    def stretches(self, lang: str, part: int) -> Iterator[dict]:
        """LEAVES leaves at a time, in order."""
        if not self.terms:
            return
        order, place, source, n, docs = self.summed()
        names = list(self.names)
        for at in range(0, len(order), LEAVES):
            lo, hi = np.searchsorted(place, [at, at + LEAVES])
            used, own = np.unique(source[lo:hi], return_inverse=True)
            terms = [self.terms[k] for k in order[at : at + LEAVES].tolist()]
            yield {"lang": lang, "part": part, "names": [names[k] for k in used.tolist()], "terms": terms, "sizes": np.bincount(place[lo:hi] - at, minlength=len(terms)), "sources": own, "n": n[lo:hi], "docs": docs[lo:hi]}

    def merge(self, row: dict) -> None:
        """Add a stretch of another trie."""
        numbers = np.array([self.names.setdefault(x, len(self.names)) for x in row["names"]])
        self.add(row["terms"].to_pylist(), numbers[row["sources"]], row["n"], row["docs"], row["sizes"])


def packed(row: dict, schema: pa.Schema) -> pa.RecordBatch:
    """A row as a batch; lists may be arrays."""
    made = []
    for f in schema:
        x = row[f.name]
        if pa.types.is_list(f.type):
            values = x if isinstance(x, pa.Array) else pa.array(x, f.type.value_type)
            made.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
        else:
            made.append(pa.array([x], f.type))
    return pa.RecordBatch.from_arrays(made, schema=schema)


NUMBERS = ("sizes", "sources", "n", "docs", "totals")


def unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of batches: lists of numbers as arrays, terms as they are, all others as Python has them."""
    for batch in batches:
        columns = dict(zip(batch.schema.names, batch.columns))
        for k in range(batch.num_rows):
            row = {c: x[k] for c, x in columns.items()}
            yield {c: x.values.to_numpy(zero_copy_only=False) if c in NUMBERS else x.values if c == "terms" else x.as_py() for c, x in row.items()}


def tries(docs: DataFrame) -> DataFrame:
    """Packed tries of each task, ``part`` being the task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), defaultdict(RadixTrie)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, trie in made.items():
                for row in trie.stretches(lang, part):
                    yield packed(row, STRETCH)
            made.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found: Counter = Counter()
                for terms in word_lists(text.as_py().translate(TERM_BYTES), TERMS_AT_ONCE):
                    found.update(terms)
                made[lang].add(found, source, np.fromiter(found.values(), np.int64, len(found)), np.ones(len(found), np.int64))
            if sum(len(trie.terms) for trie in made.values()) >= TERMS:
                yield from out()
        yield from out()

    return docs.select("lang", "source", utf8("text").alias("text")).mapInArrow(count, STRETCH_SQL)


def boundaries(stretches: DataFrame, s: Settings) -> dict[str, list[bytes]]:
    """Terms at which the ranges of each language begin, from marks at every sixteenth of the stretches; of more than MARKS
    marks a share by hash. They settle only how the merge is dealt out."""
    size = F.size("terms")
    places = F.sequence(F.lit(0), size - 1, F.greatest(F.ceil(size / 16).cast("int"), F.lit(1)))
    marks = F.transform(places, lambda i: F.struct(F.get("terms", i).alias("term"), (F.size("n") / F.size(places)).alias("w")))
    sizes = stretches.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("n")), F.lit(0)).alias("n")).first()
    thin = max(1, -(-sizes.rows * 16 // MARKS))
    found = stretches.filter(F.pmod(F.xxhash64("lang", "part", F.get("terms", F.lit(0))), F.lit(thin)) == 0).select("lang", F.inline(marks))
    most, cuts, passed = max(s.range_leaves, sizes.n // s.ranges), defaultdict(list), 0.0
    last = None
    for m in sorted(found.collect()):
        term = bytes(m.term)
        if m.lang == last and passed >= most and (not cuts[last] or cuts[last][-1] != term):
            cuts[last].append(term)
            passed = 0.0
        passed = m.w * thin + (passed if m.lang == last else 0.0)
        last = m.lang
    return dict(cuts)


def ranged(stretches: DataFrame, cuts: dict[str, list[bytes]]) -> DataFrame:
    """Stretches cut at the ranges' first terms, with ``range``."""
    sent = stretches.sparkSession.sparkContext.broadcast(cuts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in unpacked(batches):
            bounds, terms, ends = sent.value.get(row["lang"], []), row["terms"], np.cumsum(row["sizes"])
            term = lambda i: terms[i].as_py()
            at = 0
            for k in range(bisect_right(bounds, term(0)), len(bounds) + 1):
                to = bisect_left(range(len(terms)), bounds[k], key=term) if k < len(bounds) else len(terms)
                if to > at:
                    lo, hi = ends[at] - row["sizes"][at], ends[to - 1]
                    yield packed(row | {c: row[c][lo:hi] for c in ("sources", "n", "docs")} | {"terms": terms[at:to], "sizes": row["sizes"][at:to], "range": k}, RANGED)
                at = to
                if at == len(terms):
                    break

    return stretches.mapInArrow(cut, STRETCH_SQL + ", range long")


def merged(scratch: Scratch, stretches: DataFrame, last: int) -> DataFrame:
    """One trie of each (lang, range), by rounds that merge those of FAN parts; ``last`` is the largest part."""
    def meet(table: pa.Table) -> pa.Table:
        trie = RadixTrie()
        for row in unpacked(table.to_batches()):
            trie.merge(row)
        return pa.Table.from_batches([packed(x | {"range": row["range"]}, RANGED) for x in trie.stretches(row["lang"], row["part"])], schema=RANGED)

    k = 0
    while True:
        stretches = stretches.withColumn("part", F.shiftright("part", FAN.bit_length() - 1)).groupBy("lang", "range", "part").applyInArrow(meet, STRETCH_SQL + ", range long")
        last //= FAN
        if not last:
            return stretches
        stretches, k = scratch.save(stretches, f"merged{k}"), k + 1


def kept_terms(stretches: DataFrame, least_docs: int) -> DataFrame:
    """Merged stretches without the terms of fewer documents; ``totals`` has the occurrences of each of ``names``."""
    schema = pa.schema([STRETCH.field(c) for c in ("lang", "names", "terms", "sizes", "sources", "n")] + [("totals", pa.list_(pa.int64()))])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in unpacked(batches):
            sizes = row["sizes"]
            stays = np.add.reduceat(row["docs"], np.cumsum(sizes) - sizes) >= least_docs
            if stays.any():
                inner = np.repeat(stays, sizes)
                sources, n = row["sources"][inner], row["n"][inner]
                totals = np.zeros(len(row["names"]), np.int64)
                np.add.at(totals, sources, n)
                yield packed(row | {"terms": row["terms"].filter(pa.array(stays)), "sizes": sizes[stays], "sources": sources, "n": n, "totals": totals}, schema)

    return stretches.mapInArrow(keep, "lang string, names array<string>, terms array<binary>, sizes array<int>, sources array<int>, n array<long>, totals array<long>")


def share(n: np.ndarray, of: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * (n + 1) / of) for n < of, three digits at a time: exact in 64 bits while ``of`` is below 9e15."""
    out, rest = (n + 1) // of, (n + 1) % of
    for _ in range(3):
        out, rest = out * 1000 + rest * 1000 // of, rest * 1000 % of
    return out + 1


def compared(kept: DataFrame, top: int) -> DataFrame:
    """``lang, source, part, item, value`` from stretches beside their language's ``groups`` (source, n) and ``v``: a task's
    sums for each pair of sources, and its best ``top`` candidates of each source."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: dict[str, np.ndarray] = {}
        best: dict[tuple[str, int], list[tuple]] = {}
        groups: dict[str, tuple[list[str], np.ndarray]] = {}
        for row in unpacked(batches):
            lang = row["lang"]
            names, of = groups.setdefault(lang, ([g["source"] for g in row["groups"]], np.array([g["n"] for g in row["groups"]], np.int64) + row["v"]))
            place = {name: k for k, name in enumerate(names)}
            columns = np.array([place[x] for x in row["names"]])[row["sources"]]
            step = max(1, (1 << 20) // len(names))  # cells of counts at once
            sizes = row["sizes"]
            ends = np.cumsum(sizes)
            sums = pairs.setdefault(lang, np.zeros((len(names), len(names)), np.int64))
            for at in range(0, len(sizes), step):
                own = sizes[at : at + step]
                lo, hi = ends[at] - own[0], ends[at + len(own) - 1]
                counts = np.zeros((len(own), len(names)), np.int64)
                counts[np.repeat(np.arange(len(own)), own), columns[lo:hi]] = row["n"][lo:hi]
                p, q = share(counts, of), share(counts.sum(1), int(of.sum() - row["v"] * (len(names) - 1)))
                for k in range(len(names)):
                    off = p[:, k, None] - p
                    sums[k] += (off * off // p).sum(0)
                off = p - q[:, None]
                value = np.where((counts > 0) & (off > 0), off * off // q[:, None], -1)
                for k in range(len(names)):
                    able = np.flatnonzero(value[:, k] >= 0)
                    able = able[np.argsort(-value[able, k], kind="stable")[:top]]  # leaves stand in UTF-8 order
                    found = [(-int(value[i, k]), row["terms"][at + i].as_py()) for i in able.tolist()]
                    best[lang, k] = heapq.nsmallest(top, best.get((lang, k), []) + found)
        for lang, sums in pairs.items():
            names = groups[lang][0]
            rows = [(lang, a, "pair", b, int(sums[i, k])) for i, a in enumerate(names) for k, b in enumerate(names) if i != k]
            rows += [(lang, a, "term", t.decode("utf-8", "replace"), -v) for i, a in enumerate(names) for v, t in best[lang, i]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), FOUND)], schema=FOUND)

    return kept.mapInArrow(compare, FOUND_SQL)


def audit(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``lang, source, part, item, value, rank``: for each (lang, source) of ``docs`` all other sources of the language by
    divergence (``pair``), and its terms most over the language's share (``term``).

    Null texts, languages and sources are empty ones. A group without terms is told of with shares of zero counts; a
    language without kept terms has pairs of value 0; a source alone in its language has no pairs. Ties go by the item's
    bytes. Repeated rows are documents of their own; very long texts are read in stretches; other columns are ignored; an
    empty table gives an empty result. Sources of one language are held in one row, as the report holds their square.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), "text")
    stretches = scratch.save(tries(rows), "tries")
    cut = ranged(stretches, boundaries(stretches, s))
    last = stretches.agg(F.coalesce(F.max("part"), F.lit(0)).alias("part")).first().part
    kept = scratch.save(kept_terms(merged(scratch, cut, last), s.least_docs), "kept")
    totals = kept.select("lang", F.inline(F.arrays_zip(F.col("names").alias("source"), F.col("totals").alias("n"))))
    totals = totals.union(rows.select("lang", "source", F.lit(0).cast("long"))).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    sizes = kept.groupBy("lang").agg(F.sum(F.size("terms")).alias("v"))
    heads = scratch.save(totals.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("groups")).join(sizes, "lang", "left"), "heads")
    found = scratch.save(compared(kept.select("lang", "names", "terms", "sizes", "sources", "n").join(heads.filter("v > 0"), "lang"), s.top), "found")
    every = heads.select("lang", F.explode("groups.source").alias("source"), "groups").select("lang", "source", F.explode("groups.source").alias("item")).filter("source <> item")
    pairs = found.filter("part = 'pair'").select("lang", "source", "item", "value").union(every.select("*", F.lit(0).cast("long")))
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = [F.col("value").desc(), F.col("item")]
    place = lambda *by: F.row_number().over(Window.partitionBy("lang", "source", *by).orderBy(*order))
    terms = found.filter("part = 'term'").select("lang", "source", "item", "value")
    terms = terms.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALTS))).withColumn("rank", place("salt")).filter(F.col("rank") <= s.top)
    terms = terms.withColumn("rank", place()).filter(F.col("rank") <= s.top).drop("salt")
    pairs = pairs.withColumn("rank", place())
    shape = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return shape(pairs, "pair").union(shape(terms, "term"))
