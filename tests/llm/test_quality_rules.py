import random
import re
from collections import Counter, defaultdict

import numpy as np

from trackloom.llm import quality_rules as q

SCHEMA = "doc_id long, text string, source string, copy string, Lines string, at string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in " ".join(words(line)))


def plain(docs, s):
    texts, holds = defaultdict(set), defaultdict(set)
    for _, text, host in docs:
        texts[host or ""].add(text or "")
        for line in (text or "").split("\n"):
            if words(line):
                holds[host or "", key(line)].add(text or "")
    gone = {k for k, v in holds.items() if len(v) >= s.line_docs and 100 * len(v) >= s.line_percent * len(texts[k[0]])}
    out = []
    for doc_id, text, host in docs:
        text, ws = text or "", words(text)
        windows = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
        again = {k for i in range(len(ws) - 7) if windows[tuple(ws[i : i + 8])] > 1 for k in range(i, i + 8)}
        own = [x for x in text.split("\n") if words(x)]
        lost = sum(len(words(x)) for x in own if (host or "", key(x)) in gone)
        failed = len(ws) < 20 or 100 * len(again) > 30 * len(ws)
        out.append((doc_id, len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(own) - len(set(own)), len(again), failed, not failed and 100 * lost <= s.lost_percent * len(ws), lost))
    return sorted(out, key=str), gone


def corpus():
    rng = random.Random(4)
    vocabulary = ["été", "Word", "#tag", "a", "b|c", "<p>", "日本", "end.", "x y"]
    sentence = lambda n: " ".join(rng.choice(vocabulary) + str(rng.randint(0, 99)) for _ in range(n))
    docs = [(k, "\n".join(sentence(rng.randint(0, 20)) for _ in range(rng.randint(0, 6))), f"h{k % 3}") for k in range(150)]
    banner = "All rights   RESERVED by the publisher of these many pages, see the terms"
    other = "Sign in   to read on, or go back to where You came from and try again"
    docs += [(200 + k, f"{banner}\n{sentence(2)}\n{other}\t\nall Rights reserved\n", "h0") for k in range(12)]  # depleted
    docs += [(300 + k, f"{banner}\n{sentence(40)}", "h0") for k in range(3)]  # loses a line and stays
    docs += [(400, "the same text of a document, told over and over in its host by copies of copies of it without any change", "h1")] * 40
    docs += [(None, None, None), (None, "", "h2"), (1000, "one two three four five six seven eight " * 9, "h2"), (6, sentence(40000), None), (6, "a\n\n a\na\n a", "h0")]
    return docs, banner


def frame(spark, docs):
    return spark.createDataFrame([(*x, "c", "l", "a") for x in docs], SCHEMA)


def test_against_plain(spark):
    docs, banner = corpus()
    s = q.Settings()
    want, gone = plain(docs, s)
    assert ("h0", key(banner)) in gone and sum(not r[7] and not r[6] for r in want) >= 12
    assert sorted(map(tuple, q.report(frame(spark, docs).repartition(4), s).collect()), key=str) == want


def test_clean(spark):
    docs, banner = corpus()
    want, gone = plain(docs, q.Settings())
    kept = Counter(r[0] for r in want if r[7])
    rows = frame(spark, docs)
    got = q.clean(rows)
    assert got.columns == rows.columns
    texts = {x[0]: x for x in docs}
    found = got.collect()
    assert Counter(r.doc_id for r in found) == kept
    for r in found:
        _, text, host = texts[r.doc_id] if r.doc_id != 6 else next(x for x in docs if x[0] == 6 and x[2] == r.source)
        assert r.text == "\n".join(x for x in text.split("\n") if (host or "", key(x)) not in gone)


def test_empty(spark):
    assert q.report(frame(spark, [])).collect() == [] and q.clean(frame(spark, [])).collect() == []


def test_repeated_windows():
    rng = np.random.default_rng(1)
    for n in range(60):
        ids = rng.integers(0, 2, n)
        windows = Counter(tuple(ids[i : i + 8]) for i in range(n - 7))
        assert q.repeated(ids) == len({k for i in range(n - 7) if windows[tuple(ids[i : i + 8])] > 1 for k in range(i, i + 8)})
