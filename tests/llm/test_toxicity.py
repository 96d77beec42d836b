import itertools

import numpy as np

from trackloom.llm import toxicity as t

SMALL = t.Settings(max_rows=200, bits=14, kept_terms=512, epochs=40)
DOCS = "doc_id long, text string, score string, toxic string"
LABELS = "doc_id long, quality int, toxic int, text string"


def corpus(n=400):
    rng = np.random.default_rng(0)
    words = [f"w{k}ord" for k in range(60)]
    rows = []
    for k in range(n):
        text = list(rng.choice(words, 30))
        bad = k % 4 == 0
        if bad:
            text[5] = "vilestem" + rng.choice(words)
        rows.append((k, " ".join(text), int(bad)))
    return rows


def test_terms_are_distinct():
    texts = [b"", b"abcd abcd", b"ABCD\tabcd", b"abcd " + b"efgh " * 300, b"xabcd"]
    text, term = t.terms_of(texts, SMALL)
    by = [term[text == k] for k in range(5)]
    assert not len(by[0]) and set(by[1]) == set(by[2]) and all(len(set(x)) == len(x) for x in by)
    space = 1 << SMALL.bits
    start = {x for x in by[1].tolist() if x < space}  # one beginning of four bytes, told often
    assert len(by[1]) == 2 and {x + space for x in start} <= set(by[1].tolist())
    assert start <= set(by[3].tolist()) and not {x + space for x in start} & set(by[3].tolist())  # one of 301 words
    assert not start & set(by[4].tolist())  # no beginning inside a word


def test_a_very_long_text_does_not_empty_its_class(spark):
    rows = corpus()
    h = spark.createDataFrame([(r[0],) for r in rows], "doc_id long").selectExpr("doc_id", "xxhash64(doc_id) as h").orderBy("h").collect()
    first = next(r.doc_id for r in h if r.doc_id % 4 == 0)
    long = [(k, x if k != first else x + " w" * (2 << 20), y) for k, x, y in rows]
    docs = spark.createDataFrame([(k, x, "", "") for k, x, _ in long], DOCS)
    labels = spark.createDataFrame([(k, 1, y, "") for k, _, y in rows], LABELS)
    texts, found = t.training_sample(docs, labels, SMALL)
    usual = t.training_sample(spark.createDataFrame([(k, x, "", "") for k, x, _ in rows], DOCS), labels, SMALL)[1]
    assert found.sum() >= usual.sum() - 1 > 50 and (found == 0).sum() == (usual == 0).sum() and max(map(len, texts)) < SMALL.max_text


def test_batches_do_not_leak_between_texts():
    rows = [r[1].encode() for r in corpus(40)]
    model = t.fit(rows, np.array([k % 4 == 0 for k in range(40)]).astype(int), SMALL)
    alone = np.concatenate([model.scores([x]) for x in rows])
    assert np.allclose(alone, model.scores(rows))


def test_formula_against_pairs():
    rows = [r[1].encode() for r in corpus(60)]
    model = t.fit(rows, np.array([r[2] for r in corpus(60)]), SMALL)
    _, at = t.terms_of([rows[3]], SMALL, model.place)
    y = float(model.bias) + model.w[at].sum() + sum(float(model.v[i] @ model.v[j]) for i, j in itertools.combinations(at, 2))
    assert abs(model.scores([rows[3]])[0] - 1 / (1 + np.exp(-y))) < 1e-4


def test_interaction_is_learned():
    """Neither word alone is toxic; both together are."""
    rng = np.random.default_rng(1)
    fill = ["tree", "river", "stone", "cloud", "table"]
    texts, y = [], []
    for k in range(600):
        a, b = k % 2, (k // 2) % 2
        words = [*rng.choice(fill, 8), *["qqqqqqq"] * a, *["zzzzzzz"] * b]
        rng.shuffle(words)
        texts.append(" ".join(words).encode())
        y.append(a & b)
    model = t.fit(texts, np.array(y), t.Settings(bits=14, kept_terms=64, epochs=60))
    p = model.scores(texts) >= 0.3
    assert (p == np.array(y)).mean() > 0.97


def test_held_out(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, x, "s", "t") for d, x, _ in rows] + [(None, None, "s", "t"), (1, "", "s", "t"), (2, "w " * 40000, None, None)], DOCS)
    labels = spark.createDataFrame([(d, 1, y, "z") for d, _, y in rows] + [(None, 1, 1, "z"), (5, None, None, "z"), (7, 1, 1, "z")], LABELS)
    got = t.judge(docs, labels, settings=SMALL).collect()
    assert len(got) == len(rows) + 3
    truth = {d: y for d, _, y in rows}
    held = [r for r in got if r.held_out]
    assert held and all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    kept = t.reject(docs, labels, settings=SMALL)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r.predicted for r in got)


def test_empty_tables_and_one_class(spark):
    none, no_labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert t.judge(none, no_labels, settings=SMALL).collect() == []
    docs = spark.createDataFrame([(1, "a", "", "")], DOCS)
    assert t.judge(docs, no_labels, settings=SMALL).first().predicted == 0
    ones = spark.createDataFrame([(1, 1, 1, "")], LABELS)
    assert t.judge(docs, ones, settings=SMALL).first().predicted == 1
