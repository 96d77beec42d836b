"""Exact removal of byte strings that also start in a document of smaller id.

A suffix array finds repeats as neighbours that share a prefix. Sorting all suffixes, or the two thirds of a mod-3 difference
cover of them, needs several shuffles of a record for every byte. What a difference cover is for, that any two equal
strings meet at a sampled position with the same offset in both, a content-defined sample gives with far fewer positions:
of every 50-byte string the 25-byte gram of smallest hash is sampled (``anchors``), a fifteenth of all positions. So

1. whole copies of a smaller document are settled by a hash of the text; they take no further part;
2. anchors are named by the hash of their gram and sorted by name; names of one document only cannot be part of a repeat;
3. the other anchors go on with the bytes around them, which hold every 50-byte string that the anchor stands for; of equal
   surroundings in one batch only the smallest document's goes on. The strings are sorted and neighbours compared byte by
   byte, and each string's smallest document removes it from the others;
4. what was removed is brought together for each document that has any.

Every step sorts fixed-width numbers in numpy, packed in a row for each bucket of names; texts and surroundings travel
compressed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import Scratch, mix64, sieve, utf8

LENGTH, GRAM = 50, 25
SPAN = LENGTH - GRAM + 1
BASE = 0x9E3779B97F4A7C15
NULL_ID = 2**63 - 1
NAME_BYTES = 5
PIECE = 1 << 19
NAMED, PACKED, HELD = 8 << 20, 8 << 20, 50_000
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
            p = np.full(n + n // 2 + 1, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def window_hashes(raw: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every string of ``width`` bytes, equal for equal strings wherever they are."""
    n = len(raw) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _powers(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    return mix64((total[width:] - total[:n]) * down[:n])


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over every ``width`` neighbours."""
    size, out = 1, x
    while 2 * size <= width:
        out = f(out[:-size], out[size:])
        size *= 2
    return f(out[: len(x) - width + 1], out[width - size : width - size + len(x) - width + 1]) if size < width else out


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position in the text, name) of the sampled grams of all texts."""
    lengths = np.array([len(x) for x in texts], np.int64)
    ends = np.cumsum(lengths)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    if len(raw) < LENGTH:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    grams = window_hashes(raw, GRAM) | np.uint64(1)  # 0 stands for none
    text = np.repeat(np.arange(len(texts)), lengths)
    least = _slide(grams, SPAN, np.minimum)
    least[np.arange(len(least)) + LENGTH > ends[text[: len(least)]]] = 0  # strings that cross texts
    padded = np.concatenate([np.zeros(SPAN - 1, np.uint64), least, np.zeros(SPAN - 1, np.uint64)])
    at = np.flatnonzero(_slide(padded, SPAN, np.maximum) == grams)
    return text[at], at - (ends - lengths)[text[at]], grams[at]


def _pieces(texts: list[bytes], most: int = PIECE) -> Iterator[tuple[int, list[bytes]]]:
    k = 0
    while k < len(texts):
        n, size = k, 0
        while n < len(texts) and (n == k or size + len(texts[n]) <= most):
            size += len(texts[n])
            n += 1
        yield k, texts[k:n]
        k = n


def _gathered(rows: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.Table]:
    """Batches together until their texts have ``most`` bytes, so that a task hands on few and long packed rows."""
    held, size = [], 0
    for batch in rows:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _packed(schema: pa.Schema, groups: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A row for each value of ``groups``, of the columns' bytes in their order."""
    if len(groups):
        order = np.argsort(groups, kind="stable")
        cuts = np.flatnonzero(np.diff(groups[order])) + 1
        starts, stops = np.concatenate([[0], cuts]).tolist(), np.concatenate([cuts, [len(order)]]).tolist()
        arrays = [pa.array(groups[order][starts], pa.int64())]
        for c in columns:
            c = np.ascontiguousarray(c[order])
            arrays.append(pa.array([c[a:b].tobytes() for a, b in zip(starts, stops)], pa.binary()))
        yield pa.RecordBatch.from_arrays(arrays, schema=schema)


def _joined(table: pa.Table, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)


def _part(numbers: np.ndarray, parts: int) -> np.ndarray:
    """pmod, as Spark deals the texts."""
    return np.mod(numbers, np.int64(parts))


def _short(name: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, name): a name goes by five of its bytes and its bucket. Two grams under one name cost work, not rightness."""
    bucket = (name >> np.uint64(8 * NAME_BYTES)) % np.uint64(buckets)
    return bucket.astype(np.int64), ((name & np.uint64((1 << 8 * NAME_BYTES) - 1)) | bucket << np.uint64(8 * NAME_BYTES)).view(np.int64)


NAMES = pa.schema([("bucket", pa.int64()), ("names", pa.binary()), ("docs", pa.binary())])


def _name_anchors(buckets: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(rows, 1, NAMED):
            ids, found = table.column(0).to_numpy(), [(np.empty(0, np.int64), np.empty(0, np.uint64))]
            for k, some in _pieces(table.column(1).to_pylist()):
                text, _, name = anchors(some)
                found.append((ids[k + text], name))
            doc, name = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
            order = np.lexsort((doc, name))
            doc, name = doc[order], name[order]
            new = np.ones(len(name), bool)
            new[1:] = (np.diff(doc) != 0) | (name[1:] != name[:-1])
            doc, name = doc[new], name[new]
            # a name of two documents of this batch is known to repeat; one record tells the other batches
            same = name[1:] == name[:-1]
            again, lead = np.zeros(len(name), bool), np.ones(len(name), bool)
            again[1:] |= same
            again[:-1] |= same
            lead[1:] = ~same
            bucket, short = _short(name, buckets)
            # in the order of documents, whose ids then compress to little
            by = np.argsort(doc, kind="stable")
            ask, told = by[lead[by]], by[again[by]]
            yield from _packed(NAMES, bucket[ask], [short[ask].view(np.uint8).reshape(-1, 8)[:, :NAME_BYTES], doc[ask]])
            yield from _packed(NAMES, -1 - _part(doc[told], buckets), [short[told], doc[told]])

    return run


PART = pa.schema([("part", pa.int64()), ("names", pa.binary()), ("docs", pa.binary())])


def _repeated_names(buckets: int):
    def run(group: pa.Table) -> pa.Table:
        number, docs = group.column("bucket")[0].as_py(), _joined(group, "docs", np.int64)
        if number >= 0:
            wide = np.zeros((len(docs), 8), np.uint8)
            wide[:, :NAME_BYTES] = _joined(group, "names", np.uint8).reshape(-1, NAME_BYTES)
            names = wide.view(np.int64).reshape(-1) | np.int64(number << 8 * NAME_BYTES)
            order = np.lexsort((docs, names))
            names, docs = names[order], docs[order]
            first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else order
            size = np.diff(np.concatenate([first, [len(names)]]))
            # records of one document's name come from different batches only if the document was repeated there
            several = np.repeat((np.minimum.reduceat(docs, first) != np.maximum.reduceat(docs, first)), size) if len(names) else np.empty(0, bool)
            names, docs = names[several], docs[several]
        else:
            names = _joined(group, "names", np.int64)
        by = np.argsort(docs, kind="stable")
        parts = list(_packed(PART, _part(docs[by], buckets), [names[by], docs[by]]))
        return pa.Table.from_batches(parts, schema=PART)

    return run


TEXTS = pa.schema([("part", pa.int64()), ("dids", pa.binary()), ("keys", pa.binary()), ("sizes", pa.binary()), ("texts", pa.binary())])


def _pack_texts(parts: int, by_key: bool):
    """(did, key, data) -> a row for each part, of all its texts compressed; dealt by did or by key."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        for table in _gathered(rows, 2, PACKED):
            did, key, texts = table.column(0).to_numpy(), table.column(1).to_numpy(), table.column(2).to_pylist()
            part, sizes = _part(key if by_key else did, parts), np.array([len(x) for x in texts], np.int64)
            for p in np.unique(part).tolist():
                at = np.flatnonzero(part == p)
                arrays = [did[at].tobytes(), key[at].tobytes(), sizes[at].tobytes(), pack.compress(b"".join([texts[k] for k in at.tolist()]))]
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), *(pa.array([x], pa.binary()) for x in arrays)], schema=TEXTS)

    return run


def _unpacked(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for dids, keys, sizes, texts in zip(*(table.column(c).to_pylist() for c in ("dids", "keys", "sizes", "texts"))):
        ends, data = np.cumsum(np.frombuffer(sizes, np.int64)).tolist(), unpack.decompress(texts)
        yield np.frombuffer(dids, np.int64), np.frombuffer(keys, np.int64), [data[a:b] for a, b in zip([0, *ends[:-1]], ends)]


AROUND = 2 * LENGTH - GRAM
CONTEXT = pa.schema([("bucket", pa.int64()), ("names", pa.binary()), ("docs", pa.binary()), ("keys", pa.binary()), ("places", pa.binary()), ("around", pa.binary())])


def _contexts(buckets: int):
    def handed(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        short, doc, key, place, around = (np.concatenate(x) for x in zip(*held))
        # of equal whole surroundings the smallest document's go on, and the others' strings are removed
        order = np.flatnonzero((place[:, 0] >= SPAN - 1) & (place[:, 0] + LENGTH <= place[:, 1]))
        h = _line_hashes(around[order])
        by = np.lexsort((doc[order], h))
        order, h = order[by], h[by]
        lead = np.ones(len(order), bool)
        same = np.flatnonzero(h[1:] == h[:-1]) + 1
        lead[same] = (around[order[same]] != around[order[same - 1]]).any(1)
        least = np.repeat(doc[order[lead]], np.diff(np.append(np.flatnonzero(lead), len(order))))
        known = np.zeros(len(doc), bool)
        known[order] = doc[order] > least
        begin = place[known, 0] - (SPAN - 1)
        yield from _settled(key[known], np.stack([begin, begin + AROUND], 1), -1, buckets)
        rest = np.flatnonzero(~known)
        for b in _packed(CONTEXT, short[rest] >> (8 * NAME_BYTES), [short[rest], doc[rest], key[rest], place[rest], around[rest]]):
            yield b.set_column(5, "around", pa.array([pack.compress(x) for x in b.column(5).to_pylist()], pa.binary()))

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        names, docs = _joined(found, "names", np.int64), _joined(found, "docs", np.int64)
        wanted = np.unique(mix64(names.view(np.uint64)) ^ docs.view(np.uint64))
        out, held, n = [], [], 0
        for dids, keys, data in _unpacked(texts) if len(wanted) else ():
            for first, some in _pieces(data):
                text, at, name = anchors(some)
                _, short = _short(name, buckets)
                mark = mix64(short.view(np.uint64)) ^ dids[first + text].view(np.uint64)
                hit = wanted[np.minimum(np.searchsorted(wanted, mark), len(wanted) - 1)] == mark
                text, at, short = text[hit], at[hit], short[hit]
                if len(text):
                    # bytes around the gram, which hold each string it stands for; past the text's ends, nothing valid
                    lengths = np.array([len(x) for x in some], np.int64)
                    raw = np.frombuffer(b"".join(some) + bytes(AROUND), np.uint8)
                    start = (np.cumsum(lengths) - lengths)[text] + at - (SPAN - 1)
                    around = raw[np.maximum(start[:, None] + np.arange(AROUND), 0)]
                    held.append((short, dids[first + text], keys[first + text], np.stack([at, lengths[text]], 1).astype(np.int32), around))
                    n += len(text)
                if n >= HELD:
                    out += handed(held)
                    held, n = [], 0
        if held:
            out += handed(held)
        return pa.Table.from_batches(out, schema=CONTEXT)

    return run


def _line_hashes(around: np.ndarray) -> np.ndarray:
    """A hash of each whole row of bytes."""
    words = np.zeros((len(around), -(-AROUND // 8)), np.uint64)
    words.view(np.uint8)[:, :AROUND] = around
    h = np.zeros(len(around), np.uint64)
    for c in range(words.shape[1]):
        h = mix64(h + words[:, c] * np.uint64(BASE))
    return h


def _settled(key: np.ndarray, runs: np.ndarray, sign: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Removed runs as rows of CONTEXT with numbers under 0 for buckets, on their way to the documents."""
    for b in _packed(PAIRED, sign - _part(key, parts), [key, runs.astype(np.int32)]):
        none = pa.array([b""] * b.num_rows, pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), none, none, b.column(1), b.column(2), none], schema=CONTEXT)


PAIRED = pa.schema([("part", pa.int64()), ("keys", pa.binary()), ("runs", pa.binary())])
GONE = pa.schema([("part", pa.int64()), ("keys", pa.binary()), ("runs", pa.binary()), ("who", pa.list_(pa.int64()))])


def _inner_hashes(around: np.ndarray) -> np.ndarray:
    """Hashes of the SPAN strings in each row of bytes around an anchor."""
    flat = (np.arange(len(around))[:, None] * AROUND + np.arange(SPAN)).reshape(-1)
    return window_hashes(around.reshape(-1), LENGTH)[flat]


def _sorted_strings(h: np.ndarray, row: np.ndarray, at: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, whether each begins another string): strings sorted by hash, neighbours compared byte by byte; by their bytes
    where a hash should stand for two."""
    strings = np.lib.stride_tricks.sliding_window_view(around, LENGTH, axis=1)
    by = np.argsort(h, kind="stable")

    def change() -> np.ndarray:
        new, step = np.ones(len(by), bool), 1 << 16
        for k in range(1, len(by), step):
            a, b = by[k - 1 : k - 1 + min(step, len(by) - k)], by[k : k + step]
            same = h[a] == h[b]
            a, b, both = a[same], b[same], np.flatnonzero(same) + k
            new[both[(strings[row[a], at[a]] == strings[row[b], at[b]]).all(1)]] = False
        return new

    new = change()
    if (new[1:] & (h[by[1:]] == h[by[:-1]])).any():
        by = np.lexsort((np.ascontiguousarray(strings[row, at]).view(f"V{LENGTH}").reshape(-1).view(f"S{LENGTH}"), h))
        new = change()
    return by, new


def _removed(buckets: int):
    def run(group: pa.Table) -> pa.Table:
        import zstandard

        number, out = group.column("bucket")[0].as_py(), []
        keys = _joined(group, "keys", np.int64)
        if number < 0:
            out += _told(keys, _joined(group, "places", np.int32).reshape(-1, 2), buckets)
            return pa.Table.from_batches(out, schema=GONE)
        unpack = zstandard.ZstdDecompressor()
        names, docs = _joined(group, "names", np.int64), _joined(group, "docs", np.int64)
        place = _joined(group, "places", np.int32).reshape(-1, 2).astype(np.int64)
        around = np.frombuffer(b"".join(unpack.decompress(x) for x in group.column("around").to_pylist()), np.uint8).reshape(-1, AROUND)
        order = np.argsort(names, kind="stable")
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(names[order])) + 1, [len(order)]])
        start = 0
        while start < len(cuts) - 1:  # some ten thousand anchors at a time, whole names
            end = max(start + 1, int(np.searchsorted(cuts, cuts[start] + 15_000)) - 1)
            own = order[cuts[start] : cuts[end]]
            start, n = end, len(own)
            # some thousand anchors at a time: a very common name may have many more
            hashes = np.concatenate([_inner_hashes(around[own[k : k + 4096]]) for k in range(0, n, 4096)])
            begin = (place[own, 0][:, None] - (SPAN - 1) + np.arange(SPAN)).reshape(-1)
            good = np.flatnonzero((begin >= 0) & (begin + LENGTH <= np.repeat(place[own, 1], SPAN)))
            row, offset = np.divmod(good, SPAN)
            doc = docs[own[row]]
            by, new = _sorted_strings(hashes[good], own[row], offset, around)
            if not len(by):
                continue
            first = np.flatnonzero(new)
            least = np.repeat(np.minimum.reduceat(doc[by], first), np.diff(np.concatenate([first, [len(by)]])))
            # neighbouring starts of an anchor as one run: its first start and the end of its last string
            hit = np.zeros((n, SPAN + 2), np.int8)
            gone = by[doc[by] > least]
            hit[row[gone], offset[gone] + 1] = 1
            edge = np.diff(hit, axis=1)
            row, begin = np.nonzero(edge == 1)
            end = np.nonzero(edge == -1)[1] - 1 + LENGTH
            shift = place[own[row], 0] - (SPAN - 1)
            out += _told(keys[own[row]], np.stack([shift + begin, shift + end], 1).astype(np.int32), buckets)
        return pa.Table.from_batches(out, schema=GONE)

    return run


def _told(keys: np.ndarray, runs: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    for b in _packed(PAIRED, _part(keys, parts), [keys, runs]):
        who = pa.array([np.unique(np.frombuffer(x, np.int64)).tolist() for x in b.column(1).to_pylist()], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*b.columns, who], schema=GONE)


RESULT = pa.schema([("did", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def _finish(texts: pa.Table, found: pa.Table) -> pa.Table:
    keys, runs = _joined(found, "keys", np.int64), _joined(found, "runs", np.int32).reshape(-1, 2)
    order = np.argsort(keys, kind="stable")
    keys, runs, out = keys[order], runs[order], []
    for dids, own_keys, data in _unpacked(texts):
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        for key, text in zip(own_keys.tolist(), data):
            own = runs[np.searchsorted(keys, key) : np.searchsorted(keys, key, "right")]
            cover = np.zeros(len(text) + 1, np.int64)
            np.add.at(cover, own[:, 0], 1)
            np.add.at(cover, own[:, 1], -1)
            gone = np.cumsum(cover)[:-1] > 0
            n_bytes.append(len(text))
            n_removed.append(int(gone.sum()))
            n_spans.append(int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum()))
            kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes() if len(own) else text)
        arrays = [pa.array(dids), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(kept, pa.binary())]
        out.append(pa.RecordBatch.from_arrays(arrays, schema=RESULT))
    return pa.Table.from_batches(out, schema=RESULT)


def remove_repeats(docs: DataFrame, bytes_a_task: int = 8 << 20) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` for each row of ``docs``.

    A null text is empty. A null doc_id counts as larger than all others (as does 2**63 - 1, which stands for it and
    comes back as null); other ids compare as signed numbers. Rows of one doc_id remove nothing from each other. Repeated
    rows keep a row each; very long texts are cut nowhere; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did"), utf8("text").alias("data"))
    rows = rows.withColumn("key", F.xxhash64("did", "data"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]
    buckets = int(max(16, -(-size // bytes_a_task)))

    told = rows.filter(F.octet_length("data") >= LENGTH).select("did", "key", F.md5("data").alias("text"))
    first = told.groupBy("text").agg(F.min("did").alias("least"), F.max("did").alias("most")).filter("least < most")
    copies = scratch.save(told.join(first, "text").filter("did > least").select("did", "key").distinct(), "copies")
    maybe = sieve(rows, copies, ["key"])
    held = maybe.join(copies, ["did", "key"], "left_anti").select(*rows.columns)
    live = sieve(rows, copies, ["key"], out=True).union(held)
    copied = maybe.join(copies, ["did", "key"]).select("did", F.octet_length("data").cast("long").alias("n_bytes"))

    named = live.select("did", "data").mapInArrow(_name_anchors(buckets), "bucket long, names binary, docs binary")
    repeated = scratch.save(named.groupBy("bucket").applyInArrow(_repeated_names(buckets), "part long, names binary, docs binary"), "names")
    packed = lambda some, by_key: some.select("did", "key", "data").mapInArrow(_pack_texts(buckets, by_key), "part long, dids binary, keys binary, sizes binary, texts binary").groupBy("part")
    context = packed(live, False).cogroup(repeated.groupBy("part")).applyInArrow(_contexts(buckets), "bucket long, names binary, docs binary, keys binary, places binary, around binary")
    gone = scratch.save(context.groupBy("bucket").applyInArrow(_removed(buckets), "part long, keys binary, runs binary, who array<long>"), "gone")

    # documents that lose nothing meet nothing
    losers = gone.select(F.explode("who").alias("key")).distinct()
    lost = packed(sieve(live, losers, ["key"]), True).cogroup(gone.groupBy("part")).applyInArrow(_finish, "did long, n_bytes long, n_removed long, n_spans long, kept binary")
    whole = sieve(live, losers, ["key"], out=True).select("did", F.octet_length("data").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("data").alias("kept"))
    copied = copied.select("did", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(b"").alias("kept"))
    doc_id = F.when(F.col("did") == NULL_ID, None).otherwise(F.col("did"))
    return lost.union(whole).union(copied).select(doc_id.alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
