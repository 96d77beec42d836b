"""Token ids as fixed-width bit-packed binary shards.

An id takes the fewest bits that hold the vocabulary (16 for 50,257 ids). A shard file is

    payload blocks | block offsets u64[] | doc validity u8[] | doc ids i64[] | doc lengths u64[] | trailer

with blocks of ``BLOCK`` ids. ``BLOCK`` ids of ``b`` bits fill whole 64-bit words, so a block unpacks with 64 vectorised
shifts and any token range is read by seeking to its blocks. The trailer is fixed-width: magic, bits, ids a block,
blocks, documents, ids.

Files carry the task attempt in their names and count only once the manifest, which Spark commits, lists them: a lost
executor or a speculative copy leaves an unlisted file behind, never a wrong one.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.llm.common import Scratch, open_fs

BLOCK = 1 << 16
TRAILER = "<8sIIQQQ"
TRAILER_SIZE = struct.calcsize(TRAILER)
MAGIC = b"TLPACK01"
MEMO_ENTRIES = 1_000_000


def bits_for(vocabulary: int) -> int:
    """Fewest bits that hold ids 0..vocabulary-1."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids packed little-endian at ``bits`` each; the tail is padded with zero bits to a whole 64-bit word."""
    n = len(ids)
    groups = -(-n // 64)
    lanes = np.zeros((groups, 64), np.uint64)
    lanes.reshape(-1)[:n] = ids
    words = np.zeros((groups, bits), np.uint64)
    for lane in range(64):
        word, shift = divmod(lane * bits, 64)
        words[:, word] |= lanes[:, lane] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= lanes[:, lane] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()[: -(-n * bits // 64) * 8]


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The ``n`` ids of ``pack``."""
    groups = -(-n // 64)
    words = np.zeros(groups * bits, np.uint64)
    got = np.frombuffer(data, "<u8")
    words[: len(got)] = got
    words = words.reshape(groups, bits)
    mask = np.uint64((1 << bits) - 1)
    out = np.empty((groups, 64), np.uint32)
    for lane in range(64):
        word, shift = divmod(lane * bits, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | (words[:, word + 1] << np.uint64(64 - shift))
        out[:, lane] = value & mask
    return out.reshape(-1)[:n]


class Shard:
    """Random access to one shard file."""

    def __init__(self, uri: str):
        files, path = open_fs(uri)
        self.file = files.open_input_file(path)
        size = self.file.size()
        magic, self.bits, self.block, blocks, docs, self.n_ids = struct.unpack(TRAILER, self.file.read_at(TRAILER_SIZE, size - TRAILER_SIZE))
        if magic != MAGIC:
            raise ValueError(f"not a token shard: {uri}")
        at = size - TRAILER_SIZE - blocks * 8 - docs * 17
        tail = self.file.read_at(size - TRAILER_SIZE - at, at)
        self.offsets = np.frombuffer(tail, "<u8", blocks)
        self.valid = np.frombuffer(tail, np.uint8, docs, blocks * 8).astype(bool)
        self.doc_ids = np.frombuffer(tail, "<i8", docs, blocks * 8 + docs)
        self.lengths = np.frombuffer(tail, "<u8", docs, blocks * 8 + docs * 9).astype(np.int64)
        self.ends = np.cumsum(self.lengths)
        self.payload_end = at

    def read_block(self, k: int) -> np.ndarray:
        start = int(self.offsets[k])
        end = int(self.offsets[k + 1]) if k + 1 < len(self.offsets) else self.payload_end
        return unpack(self.file.read_at(end - start, start), min(self.block, self.n_ids - k * self.block), self.bits)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids [start, end) of the shard; only the blocks that hold them are read."""
        if end <= start:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        got = np.concatenate([self.read_block(k) for k in range(first, last + 1)])
        return got[start - first * self.block : end - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k] - self.lengths[k]), int(self.ends[k]))

    def documents(self) -> Iterator[np.ndarray]:
        """All documents in file order, one block in memory beside the current document."""
        have, k = np.empty(0, np.uint32), 0
        for n in self.lengths.tolist():
            parts, size = [have], len(have)
            while size < n:
                parts.append(self.read_block(k))
                size += len(parts[-1])
                k += 1
            have = np.concatenate(parts) if len(parts) > 1 else have
            yield have[:n]
            have = have[n:]

    def close(self) -> None:
        self.file.close()


class Encoder:
    """Byte-level BPE ids of whole texts by the ``tokenizers`` library.

    Byte-level BPE encodes each pre-token by itself, and invented or natural prose repeats its pre-tokens, so texts of
    plain Latin letters, digits, punctuation, blanks and newlines are cut into pre-tokens here and the library encodes each
    distinct one once by its own BPE model (a bounded memo). Any text with another character or a special token's mark goes to the library
    whole. Both ways give the ids of ``Tokenizer.encode(text, add_special_tokens=False)``.
    """

    PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-ɏ]*")
    PIECES = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")

    def __init__(self, spec: str, entries: int = MEMO_ENTRIES):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.entries, self.memo = entries, {}
        parsed = json.loads(spec)
        pre = parsed.get("pre_tokenizer") or {}
        self.marks = [t["content"] for t in parsed.get("added_tokens", [])]
        model = parsed.get("model", {})
        special = any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        self.by_piece = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not parsed.get("normalizer") and model.get("type") == "BPE" and not special
        if self.by_piece:
            from tokenizers.models import BPE

            self.model = BPE(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]], cache_capacity=0)
            # byte-level alphabet: printable bytes stand for themselves, the others for the characters from U+0100 on
            printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
            others = [x for x in range(256) if x not in set(printable)]
            self.byte_chars = {x: x for x in printable} | {x: 0x100 + k for k, x in enumerate(others)}

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.by_piece or not self.PLAIN.fullmatch(text) or any(m in text for m in self.marks):
            return self._whole(text)
        return self._pieces(text)

    def _pieces(self, text: str) -> bytes:
        pieces, memo = self.PIECES.findall(text), self.memo
        try:
            return b"".join(map(memo.__getitem__, pieces))
        except KeyError:
            new = {x for x in pieces if x not in memo}
        if len(memo) + len(new) > self.entries:
            memo.clear()
            new = set(pieces)
        byte_chars, tokens = self.byte_chars, self.model.tokenize
        for x in new:
            memo[x] = array("I", [t.id for t in tokens(x.encode().decode("latin-1").translate(byte_chars))]).tobytes()
        return b"".join(map(memo.__getitem__, pieces))

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _write(folder: str, spec, vocabulary: int, end_id: int):
    bits = bits_for(max(vocabulary, end_id + 1))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, end = Encoder(spec.value), struct.pack("<I", end_id)
        files, root = open_fs(folder)
        part = TaskContext.get().partitionId()
        name = f"shard-{part:08d}-{uuid.uuid4().hex}.bin"
        offsets, valid, doc_ids, lengths, waiting, held, at, total = [], [], [], [], [], 0, 0, 0
        out = None
        for batch in rows:
            if not batch.num_rows:
                continue
            if out is None:
                files.create_dir(root, recursive=True)
                out = files.open_output_stream(f"{root}/{name}")
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encoder.encode(text or "") + end
                valid.append(doc is not None)
                doc_ids.append(doc or 0)
                lengths.append(len(ids) // 4)
                waiting.append(ids)
                held += lengths[-1]
                if held >= BLOCK:
                    ready = np.frombuffer(b"".join(waiting), "<u4")
                    whole = len(ready) // BLOCK * BLOCK
                    for k in range(0, whole, BLOCK):
                        data = pack(ready[k : k + BLOCK], bits)
                        offsets.append(at)
                        out.write(data)
                        at += len(data)
                    total += whole
                    held = len(ready) - whole
                    waiting = [ready[whole:].tobytes()]
        if out is None:
            return
        if held:
            data = pack(np.frombuffer(b"".join(waiting), "<u4"), bits)
            offsets.append(at)
            out.write(data)
            total += held
        for values, kind in ((offsets, "<u8"), (valid, np.uint8), (doc_ids, "<i8"), (lengths, "<u8")):
            out.write(np.array(values, kind).tobytes())
        out.write(struct.pack(TRAILER, MAGIC, bits, BLOCK, len(offsets), len(lengths), total))
        out.close()
        yield pa.RecordBatch.from_pydict({"shard": [part], "path": [f"{folder}/{name}"], "n_docs": [len(lengths)], "n_ids": [total]}, pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return run


def write_shards(docs: DataFrame, tokenizer_file: str, folder: str, end_id: int = 2, scratch: Scratch | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write packed shards in ascending doc_id order; returns the committed manifest
    ``shard, path, n_docs, n_ids, start`` (start: ids in all shards before).

    Null doc_ids come first; a null text is empty and yields the end id alone; ties in doc_id are ordered by a hash of the
    text, then the text, so repeated rows give a fixed order. Other columns are ignored. An empty table gives an empty
    manifest. One range shuffle of the texts, then one streaming pass: a task holds one block and its documents' lengths.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    spec = Path(tokenizer_file).read_text(encoding="utf-8")
    vocabulary = Tokenizer.from_str(spec).get_vocab_size(with_added_tokens=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(F.asc_nulls_first("doc_id"), F.asc("tie")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie", "text").select("doc_id", "text")
    manifest = rows.mapInArrow(_write(folder, spark.sparkContext.broadcast(spec), vocabulary, end_id), "shard long, path string, n_docs long, n_ids long")
    manifest = (scratch or Scratch(spark, "tokens")).save(manifest, "manifest")
    # one row for each shard file, never for each document
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return manifest.withColumn("start", F.coalesce(before, F.lit(0)))


def read_shards(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read back from the files of a manifest."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                shard = Shard(path)
                crc = [zlib.crc32(ids.astype("<u4").tobytes()) for ids in shard.documents()]
                shard.close()
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": pa.array(shard.doc_ids, mask=~shard.valid), "start": start + shard.ends - shard.lengths, "n_tokens": shard.lengths, "ids_crc32": np.array(crc, np.int64)},
                    pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]),
                )

    shards = max(1, manifest.count())
    return manifest.select("path", "start").repartition(shards).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def encode_documents(spark: SparkSession, docs: DataFrame, tokenizer_file: str | None = None, end_id: int = 2) -> DataFrame:
    """Write ``docs`` as packed shards under the shared folder and read them back."""
    scratch = Scratch(spark, "tokens")
    return read_shards(write_shards(docs, tokenizer_file or tokenizer_path(), f"{scratch.path}/shards", end_id, scratch))
