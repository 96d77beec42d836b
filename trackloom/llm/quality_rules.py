"""Quality rules: counts over a document's own words and lines, and how often its lines occur in other documents of its host.

One pass over the texts makes a row for each document, with the counts and the hashes of its normalised lines; all else works
on these rows. Distinct documents of each (host, line) are counted by pre-aggregated shuffles; exact copies of a text count as
one document, so that copies alone never make a text's lines common. Lines above the limits go, and a document that loses most
of its words with them is rejected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import Scratch, sieve, small_batches, utf8, word_lists

LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
SYMBOLS = b"#*$%&|<>"
#: Blanks, and the bytes that go on with a character.
NOT_FIRST = b" \t\n\x0b\x0c\r" + bytes(range(0x80, 0xC0))
WORDS_AT_ONCE = 1 << 18

DIGESTS_SQL = "at long, doc_id long, host string, copy binary, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<binary>, line_words array<long>"
DIGESTS = pa.schema(
    [("at", pa.int64()), ("doc_id", pa.int64()), ("host", pa.string()), ("copy", pa.binary()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))]
    + [("lines", pa.list_(pa.binary())), ("line_words", pa.list_(pa.int64()))]
)


@dataclass(frozen=True)
class Settings:
    """``host`` names the column of a document's host. A line goes that ``line_docs`` or more different documents of the host
    hold, and ``line_percent`` of them or more; a document goes with more than ``lost_percent`` of its words in such lines,
    with fewer than ``least_words`` words, or more than ``repeat_percent`` of them in repeated windows."""

    host: str = "source"
    line_docs: int = 10
    line_percent: int = 1
    lost_percent: int = 70
    least_words: int = 20
    repeat_percent: int = 30


def repeated(ids: np.ndarray) -> int:
    """Places inside windows of eight numbers that occur twice or more. Windows get names by three doublings: a name of twice
    the width is the pair of two names, so equal names are equal windows."""
    if len(ids) < 9:
        return 0
    for step in (1, 2, 4):
        ids = np.unique(ids[:-step] * (int(ids.max()) + 1) + ids[step:], return_inverse=True)[1]
    hit = np.flatnonzero(np.bincount(ids)[ids] > 1)
    edge = np.zeros(len(ids) + 8, np.int64)
    edge[hit] += 1
    edge[hit + 8] -= 1
    return int((np.cumsum(edge) > 0).sum())


def line_key(words: list[bytes]) -> bytes:
    """Hash of a line's words, A-Z in lower case, however they are spaced."""
    return hashlib.md5(b" ".join(words).translate(LOWER)).digest()


def measured(data: bytes) -> tuple[int, int, int, int, int, list[bytes], list[int]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, line keys, words of each) of a text."""
    numbers: dict[bytes, int] = {}
    ids = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)) for words in word_lists(data, WORDS_AT_ONCE)]
    held = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    seen, again, lines = set(), 0, {}
    for line in data.split(b"\n"):
        if words := line.split():
            again += line in seen
            seen.add(line)
            key = line_key(words)
            lines[key] = lines.get(key, 0) + len(words)
    chars = len(data.translate(None, NOT_FIRST))
    return len(held), chars, len(data) - len(data.translate(None, SYMBOLS)), again, repeated(held), list(lines), list(lines.values())


def copy_key() -> Column:
    return F.unhex(F.md5(utf8("text"))).alias("copy")


def digests(docs: DataFrame, host: str) -> DataFrame:
    """A row for each document: ``at``, its place in the table that this is written to, its counts and its lines' hashes."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            found = list(zip(*(measured(text.as_py()) for text in batch.column(3)))) or [()] * 7
            arrays = [pa.array(np.arange(at, at + batch.num_rows)), *batch.columns[:3], *found]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(arrays, DIGESTS)], schema=DIGESTS)
            at += batch.num_rows

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), copy_key(), utf8("text").alias("text"))
    return rows.mapInArrow(measure, DIGESTS_SQL)


def common_lines(rows: DataFrame, s: Settings) -> DataFrame:
    """``host, line`` above the limits."""
    lines = rows.select("host", "copy", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count_distinct("copy").alias("n"))
    hosts = rows.groupBy("host").agg(F.count_distinct("copy").alias("docs"))
    return lines.filter(F.col("n") >= s.line_docs).join(hosts, "host").filter(100 * F.col("n") >= s.line_percent * F.col("docs")).select("host", "line")


def judged(docs: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """The documents' rows with ``n_lost`` (words in common lines), ``base_failed`` and ``kept``, and the common lines."""
    scratch = Scratch(docs.sparkSession, "quality")
    rows = scratch.save(digests(docs, s.host), "digests")
    gone = scratch.save(common_lines(rows, s), "lines")
    held = rows.select("at", "host", F.inline(F.arrays_zip(F.col("lines").alias("line"), F.col("line_words").alias("words"))))
    lost = sieve(held, gone, ["host", "line"]).join(gone, ["host", "line"]).groupBy("at").agg(F.sum("words").alias("n_lost"))
    out = rows.drop("lines", "line_words").join(lost, "at", "left").withColumn("n_lost", F.coalesce("n_lost", F.lit(0).cast("long")))
    failed = (F.col("n_words") < s.least_words) | (100 * F.col("n_repeat_words") > s.repeat_percent * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & (100 * F.col("n_lost") <= s.lost_percent * F.col("n_words")))
    return out, gone


def report(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lost`` for each row of ``docs``.

    A null or empty text has no words and fails; a null host is the empty one; null doc_ids and repeated rows keep a row each
    and are judged alike; very long texts are read whole, their words some at a time; other columns, whatever their names, are
    ignored; an empty table gives an empty result.
    """
    return judged(docs, s)[0].select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost")


def clean(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The kept documents, all columns in place, without the lines above the limits in ``text``."""
    scratch = Scratch(docs.sparkSession, "quality")
    rows, gone = judged(docs, s)
    rows = scratch.save(rows, "judged")
    held = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(s.host).cast("string"), F.lit("")).alias("host"), copy_key())
    # a text that is kept once in a host is kept there always, so one row for each stands for its copies
    held = held.join(rows.filter("kept").groupBy("host", "copy").agg(F.max("n_lost").alias("n_lost")), ["host", "copy"])

    @F.pandas_udf("array<binary>")
    def keys(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [line_key(words) if (words := line.encode().split()) else b"" for line in t.split("\n")])

    whole = held.filter("n_lost = 0").select("row.*")
    cut = held.filter("n_lost > 0").select("row", "host", "copy")
    texts = cut.select("host", "copy", F.col("row.text").alias("text")).dropDuplicates(["host", "copy"])
    lines = texts.select("host", "copy", F.posexplode(F.arrays_zip(F.split("text", "\n", -1).alias("words"), keys("text").alias("line")))).select("host", "copy", "pos", "col.*")
    left = lines.join(gone, ["host", "line"], "left_anti").groupBy("host", "copy").agg(F.array_sort(F.collect_list(F.struct("pos", "words"))).alias("left"))
    cut = cut.join(left, ["host", "copy"], "left")
    text = F.coalesce(F.array_join("left.words", "\n"), F.lit(""))
    return whole.union(cut.select(F.col("row").withField("text", text).alias("row")).select("row.*"))
