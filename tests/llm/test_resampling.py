import hashlib
import math
import random
import re
import zlib

import numpy as np

from trackloom.llm import resampling as r

SCHEMA = "doc_id long, text string, rank string, Range string, scores string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def grams(text):
    ws = WORD.findall(lower(text))
    return len(ws), [zlib.crc32(" ".join(ws[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(ws) - n + 1)]


def plain(docs, target):
    s, t = [0] * 10000, [0] * 10000
    for text in docs:
        for b in grams(text[1])[1]:
            s[b] += 1
    for text in target:
        for b in grams(text)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((float(t[b] + 1) * float(sum(s) + 10000)) / (float(s[b] + 1) * float(sum(t) + 10000)))) for b in range(10000)]
    out = []
    for doc_id, text in docs:
        n, found = grams(text)
        weight = sum(gain[b] for b in found)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= 20])
    able = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    draw = 5 * len(able) // 100
    ranked = [(*x[:4], k + 1 if k < draw else None) for k, x in enumerate(able)] + [(*x[:4], None) for x in out if not x[4]]
    return sorted(ranked, key=str)


def texts():
    rng = random.Random(5)
    words = ["alpha", "Beta", "été", "ÀX", "z9", "word", "x", "日本", "naïve", "the"]
    docs = [(k, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for k in range(300)]
    docs += [(None, None), (None, "a b " * 15), (7, ""), (1000, "same words here " * 9), (-5, "tab\tand\x00nul " * 12)]
    docs += [(2000, "The very same text, told again and again. " * 4)] * 200  # repeated rows: all of their keys tie
    docs += [(3000, "long tail " * 90000)]
    return docs, ["alpha beta the word", None, "", "été " * 30, "The very same text"]


def test_against_plain(spark):
    docs, target = texts()
    rows = spark.createDataFrame([(*d, "q", "z", "s") for d in docs], SCHEMA).repartition(5)
    want = plain(docs, target)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    for s in (r.Settings(), r.Settings(range_rows=3)):  # a few ranges, and many of which the last one is drawn in part
        assert sorted(map(tuple, r.resample(rows, goal, s).collect()), key=str) == want
    chosen = r.select(rows, goal)
    assert chosen.columns == rows.columns
    ids = {x[0] for x in want if x[4] and x[0] is not None}
    assert {x.doc_id for x in chosen.collect()} == ids


def test_empty(spark):
    rows = spark.createDataFrame([], SCHEMA)
    goal = spark.createDataFrame([("a b",)], "text string")
    assert r.resample(rows, goal).collect() == []
    one = spark.createDataFrame([(1, "a b c", "", "", "")], SCHEMA)
    assert [tuple(x)[:2] + (x.rank,) for x in r.resample(one, goal.limit(0)).collect()] == [(1, 6, None)]


def test_stretches(monkeypatch):
    data = "one Two three, four. five".encode() * 50
    whole = np.concatenate([b for _, b in r.features(data, 10000)])
    monkeypatch.setattr(r, "WORDS_AT_ONCE", 3)
    parts = list(r.features(data, 10000))
    assert sum(n for n, _ in parts) == 201 and sorted(np.concatenate([b for _, b in parts])) == sorted(whole)


def test_tournament():
    rng = random.Random(1)
    for k in range(9):
        runs = [sorted((rng.randint(0, 20), j, i) for i in range(rng.randint(0, 6))) for j in range(k)]
        tree = r.Tournament([iter([(x, x) for x in own]) for own in runs])
        got = []
        while top := tree.pop():
            got.append(top[0])
        assert got == sorted(x for own in runs for x in own)
