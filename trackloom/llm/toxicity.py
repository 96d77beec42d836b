"""Toxicity by a factorization machine over hashed terms.

Terms of a text are the beginnings of its words, some bytes long, and the byte n-grams inside them, lower-cased in A-Z and
hashed: stems that mark abuse inside inflected or compounded words are terms too, in any language. A term that one of
``dense`` words has, or more, is a second term, as a stem that chance leaves in a long text says less than one told often. A
factorization machine

    y(x) = w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]

over binary presence learns, beside the additive weights, pairwise interactions such as an insult next to a group
mention. It is fitted on a bounded sample of the labelled rows on the driver (``max_rows`` is the bound and the
parameter) and sent to the executors as a table of fixed size; every text is then scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import free_name, small_batches, utf8


@dataclass(frozen=True)
class Settings:
    """``max_rows`` rows of each class at most are fitted on (those of smallest hash), each with its whole text, while all of
    a class have ``max_bytes`` at most, which bounds the driver's memory; a text of more than ``max_text`` bytes is left
    out beforehand. ``bits``: size of the hashed term space. ``starts`` and ``sizes``: bytes of the beginnings of words and of
    the n-grams. ``kept_terms``: terms that are fitted, those of largest chi statistic. ``rank``: width of the interaction
    vectors."""

    max_rows: int = 2000
    max_bytes: int = 32 << 20
    max_text: int = 2 << 20
    bits: int = 20
    starts: tuple[int, ...] = (4, 5, 6, 7, 8)
    sizes: tuple[int, ...] = (5,)
    dense: int = 200
    kept_terms: int = 2048
    rank: int = 4
    epochs: int = 25
    rate: float = 0.15
    decay: float = 1e-4
    seed: int = 7


#: Bytes of words stay, A-Z in lower case; all others are blanks.
WORD_BYTES = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def terms_of(texts: list[bytes], s: Settings, place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, term) of the distinct terms of each text, in order, all texts in one pass; dense terms stand behind the
    ``1 << bits`` others. A text without words has none. With ``place`` terms are mapped by it and those at -1 left out."""
    space, pad = 1 << s.bits, max(*s.starts, *s.sizes, 1)
    framed = [b" " + x + b" " * pad for x in texts]
    ends = np.cumsum([len(x) for x in framed])
    raw = np.frombuffer(b"".join(framed).translate(WORD_BYTES) + b" " * pad, np.uint8)
    word = raw[: len(raw) - pad] != 32
    first = np.flatnonzero(word[1:] & ~word[:-1]) + 1
    words = np.bincount(np.searchsorted(ends, first, "right"), minlength=len(texts))
    kept = None if place is None else (place[:space] >= 0) | (place[space:] >= 0)
    keys = [np.empty(0, np.int64)]
    for salt, sizes, at in ((1, s.starts, first), (0, s.sizes, np.flatnonzero(word))):
        for size in sizes:
            inside, code = np.ones(len(at), bool), np.zeros(len(at), np.uint64)
            for k in range(size):
                byte = raw[at + k]
                inside &= byte != 32
                code = (code << np.uint64(8)) | byte
            own, code = at[inside], code[inside]
            term = ((code * np.uint64(0x9E3779B97F4A7C15 + 2 * size + 64 * salt)) >> np.uint64(64 - s.bits)).astype(np.int64)
            if kept is not None:
                own, term = own[kept[term]], term[kept[term]]
            keys.append((np.searchsorted(ends, own, "right") << np.int64(s.bits)) | term)
    found, n = np.unique(np.concatenate(keys), return_counts=True)
    text, term = found >> np.int64(s.bits), found & np.int64(space - 1)
    dense = n * s.dense >= words[text]
    text, term = np.concatenate([text, text[dense]]), np.concatenate([term, term[dense] + space])
    if place is not None:
        term = place[term]
        text, term = text[term >= 0], term[term >= 0]
    return text, term


def some(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first, texts) of a megabyte or so at a time."""
    k = 0
    while k < len(texts):
        n, size = k, 0
        while n < len(texts) and (n == k or size + len(texts[n]) <= 1 << 20):
            size += len(texts[n])
            n += 1
        yield k, texts[k:n]
        k = n


@dataclass
class Model:
    """``place``: hashed term -> row of ``w`` and ``v``, -1 for terms the fit passed over."""

    settings: Settings
    place: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def scores(self, texts: list[bytes]) -> np.ndarray:
        s, n = self.settings, len(texts)
        text, at = terms_of(texts, s, self.place)
        y = self.bias + np.bincount(text, self.w[at], n)
        v = self.v[at]
        for f in range(self.v.shape[1]):
            total = np.bincount(text, v[:, f], n)
            y += 0.5 * (total * total - np.bincount(text, v[:, f] * v[:, f], n))
        return 1.0 / (1.0 + np.exp(-np.clip(y, -30, 30)))


def select_terms(texts: list[bytes], labels: np.ndarray, settings: Settings) -> np.ndarray:
    """Terms of largest signed chi statistic against the labels; ties go to the smaller hash."""
    space = 2 << settings.bits
    pos, neg = np.zeros(space), np.zeros(space)
    for k, part in some(texts):
        text, term = terms_of(part, settings)
        toxic = labels[k + text] == 1
        pos += np.bincount(term[toxic], minlength=space)
        neg += np.bincount(term[~toxic], minlength=space)
    p, n = max(labels.sum(), 1), max(len(labels) - labels.sum(), 1)
    seen = pos + neg
    rate = seen / (p + n)
    weight = np.abs(pos / p - neg / n) / np.sqrt(np.maximum(rate * (1 - rate), 1e-9) * (1 / p + 1 / n))
    weight[seen < 3] = 0
    order = np.lexsort((np.arange(space), -weight))[: settings.kept_terms]
    return np.sort(order[weight[order] > 0])


def fit(texts: list[bytes], labels: np.ndarray, settings: Settings = Settings()) -> Model:
    """Adagrad on the logistic loss. Without rows of both classes every text scores the
    smoothed share of label 1."""
    s, space = settings, 2 << settings.bits
    labels = np.asarray(labels, np.int64)
    place = np.full(space, -1, np.int32)
    share = (labels.sum() + 0.1) / (len(labels) + 1.0)
    if not len(labels) or labels.min() == labels.max():
        return Model(s, place, float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, s.rank)))
    terms = select_terms(texts, labels, s)
    place[terms] = np.arange(len(terms))
    x = np.zeros((len(texts), len(terms)), np.float32)
    for k, part in some(texts):
        text, term = terms_of(part, s, place)
        x[k + text, term] = 1
    rng, f32 = np.random.default_rng(s.seed), np.float32
    w, v, bias = np.zeros(len(terms), f32), rng.normal(0, 0.01, (len(terms), s.rank)).astype(f32), f32(np.log(share / (1 - share)))
    gw, gv, gb = np.full(len(terms), 1e-3, f32), np.full(v.shape, 1e-3, f32), 1e-3
    # rejecting a clean text is the worse mistake: the clean class weighs three times as much in all
    weight = np.where(labels == 1, 0.25 / labels.sum(), 0.75 / (labels == 0).sum()).astype(f32) * len(labels)
    for _ in range(s.epochs):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), 256):
            part = order[k : k + 256]
            b = x[part]
            sums = b @ v
            y = bias + b @ w + 0.5 * ((sums * sums).sum(1) - b @ (v * v).sum(1))
            g = (weight[part] * (1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels[part]) / len(part)).astype(f32)
            back = b.T @ np.column_stack([g, g[:, None] * sums])
            dw = back[:, 0] + f32(s.decay) * w
            dv = back[:, 1:] - back[:, :1] * v + f32(s.decay) * v
            db = g.sum()
            gw += dw * dw
            gv += dv * dv
            gb += float(db * db)
            w -= f32(s.rate) * dw / np.sqrt(gw)
            v -= f32(s.rate) * dv / np.sqrt(gv)
            bias -= f32(s.rate * db / np.sqrt(gb))
    return Model(s, place, float(bias), w, v)


def training_sample(docs: DataFrame, labels: DataFrame, settings: Settings) -> tuple[list[bytes], np.ndarray]:
    """The bounded sample: of each class the ``max_rows`` labelled rows of smallest hash whose crc32(doc_id) mod 4 is not
    2. Rows with a null doc_id, label or text, and labels other than 0 and 1, are not learned from; a doc_id labelled
    twice counts once if its labels agree and not at all if they differ."""
    s = settings
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    known = known.filter(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2)
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("high")).filter("toxic = high").select("doc_id", "toxic", F.xxhash64("doc_id").alias("h"))
    # numbers alone are ordered; of a doc_id's several texts the one of smallest hash counts
    own = F.struct(F.xxhash64("text").alias("tag"), F.octet_length("text").alias("size"))
    there = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), own.alias("own"))
    there = there.join(known, "doc_id").groupBy("doc_id", "toxic", "h").agg(F.min("own").alias("own")).select("doc_id", "toxic", "h", "own.*")
    picked = None
    for label in (1, 0):
        part = there.filter((F.col("toxic") == label) & (F.col("size") <= s.max_text)).orderBy("h").limit(s.max_rows)
        part = part.withColumn("run", F.sum("size").over(Window.partitionBy("toxic").orderBy("h", "doc_id"))).filter(F.col("run") <= s.max_bytes).select("doc_id", "tag", "toxic")
        picked = part if picked is None else picked.union(part)
    texts = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), F.encode("text", "UTF-8").alias("data"))
    rows = texts.join(F.broadcast(picked), ["doc_id", "tag"])  # at most 2 * max_rows rows of three numbers
    rows = rows.groupBy("doc_id", "toxic").agg(F.any_value("data").alias("data")).orderBy("doc_id")
    got = rows.select("data", "toxic").toArrow()
    return got.column("data").to_pylist(), np.array(got.column("toxic").to_pylist(), np.int64)


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    return fit(*training_sample(docs, labels, settings), settings)


def score(docs: DataFrame, model: Model, *keep: str, name: str = "score") -> DataFrame:
    """The ``keep`` columns of ``docs`` and the score as ``name``, one row for each row of ``docs``; a null text scores as an empty
    one. No shuffle: the model (under 10 MB by its settings) is broadcast."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*keep, utf8("text").alias(free_name("data", keep)))
    schema = docs.select(*keep).schema.add(name, "double")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in rows:
            out = [m.scores(part) for _, part in some(batch.column(batch.num_columns - 1).to_pylist())]
            scores = pa.array(np.concatenate(out) if out else [], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], names=[*keep, name])

    return kept.mapInArrow(run, schema)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``. A null doc_id is not held out (null % 4 is not
    2). Repeated rows get a row each; columns of other names are ignored; an empty table gives an empty result."""
    scored = score(docs, train(docs, labels, settings), "doc_id")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, settings: Settings = Settings()) -> DataFrame:
    """``docs`` without the documents scored at or over ``threshold``. All columns stay, whatever their names; a null or
    empty text has the score of no terms, a very long one is scored whole; repeated rows are judged alike; without labels every
    text has the same low score and stays; an empty table stays empty."""
    name = free_name("score", docs.columns)
    return score(docs, train(docs, labels, settings), *docs.columns, name=name).filter(F.col(name) < threshold).select(*docs.columns)
