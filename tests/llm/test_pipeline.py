"""The pipeline's stages against plain versions, each on what the stage before it kept."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as p
from trackloom.llm import mixing, token_output, toxicity

SCHEMA = "doc_id long, text string, source string, row string, score string, did string, k1 string, __row string"


def near(a, b):
    sets = []
    for text in (a, b):
        w = text.encode().lower().split()
        n = min(5, len(w))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set())
    return bool(sets[0]) and 100 * len(sets[0] & sets[1]) >= 80 * len(sets[0] | sets[1])


def words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()) if w]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    text = lambda n: " ".join(word() for _ in range(n))
    exam = text(40)
    rows = []
    for k in range(60):
        body = text(int(rng.integers(20, 120)))
        if k % 6 == 0:
            body += " vile grubnik scum"
        if k % 10 == 3:
            body += " " + " ".join(exam.split()[5:25])
        rows.append((k, body, f"s{k % 3}"))
    copy = rows[7][1].split()
    rows += [(100, rows[7][1], "s0"), (101, " ".join([*copy[:-2], "zz", copy[-1]]), "s0"), (102, rows[7][1].upper(), "s1"), (103, "", "s1"), (104, None, None), (None, text(30), None), (105, exam, "s2"), (8, rows[8][1], "s2"), (106, text(3000), "s2")]
    docs = spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], SCHEMA)
    out = str(tmp_path_factory.mktemp("tables"))
    docs.repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 6 == 0)) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, exam), (2, None)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def key(r):
    return (r.doc_id, r.text)


def test_every_stage(spark, folder, tmp_path):
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    for name, stage in p.STAGES:
        out = stage(spark, docs, folder)
        if name != p.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        kept[name] = (docs, spark.read.parquet(str(tmp_path / name)))
        docs = kept[name][1]

    before, after = kept["toxicity"]
    judged = {(r.doc_id, r.predicted) for r in toxicity.judge(before, labels).collect()}
    assert {r.doc_id for r in after.collect()} == {d for d, bad in judged if not bad}
    rows = before.collect()
    assert Counter(map(key, after.collect())) == Counter(key(r) for r in rows if (r.doc_id, 0) in judged)

    before, after = kept["near_duplicates"]
    rows = sorted(before.collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and near(rows[i].text or "", rows[j].text or ""):
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    assert Counter(map(key, after.collect())) == Counter(key(r) for i, r in enumerate(rows) if root[i] == i)
    assert not {100, 101, 102} & {r.doc_id for r in after.collect()}

    before, after = kept["decontaminate"]
    exam = words(next(r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if r.text))
    windows = {tuple(exam[k : k + 13]) for k in range(len(exam) - 12)}
    clean = []
    for r in before.collect():
        own, hit = words(r.text), set()
        for k in range(len(own) - 12):
            if tuple(own[k : k + 13]) in windows:
                hit |= set(range(k, k + 13))
        if not (hit and 20 * len(hit) >= len(own)):
            clean.append(key(r))
    assert Counter(map(key, after.collect())) == Counter(clean)
    assert 0 < len(clean) < before.count() and 106 in {d for d, _ in clean}

    before, after = kept["mixing"]
    want = Counter()
    drawn = {r.doc_id: r.copies for r in mixing.allocate(before).collect()}
    for r in before.collect():
        want[key(r)] += drawn[r.doc_id]
    assert Counter(map(key, after.collect())) == +want

    before, after = kept["token_output"]
    assert after.count() == before.count()
    tokenizer, sums = Tokenizer.from_file(token_output.tokenizer_path()), {}
    for r in before.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        sums.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(ids.tobytes())))
    start = 0
    for r in after.orderBy("start").collect():
        assert r.start == start and (r.n_tokens, r.ids_crc32) in sums[r.doc_id]
        start += r.n_tokens


def test_run_is_the_stages_in_turn(spark, folder):
    assert [n for n, _ in p.STAGES] == ["toxicity", "near_duplicates", "decontaminate", "mixing", "token_output"]
    assert p.run(spark, folder).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_empty_tables(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in p.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0
