import math

from trackloom.llm import mixing as m

SCHEMA = "doc_id long, text string, source string, row string, __row string"


def frame(spark):
    rows = [(k, "w " * (1 + k % 7), f"s{0 if k % 3 else k % 5}") for k in range(400)] + [(None, None, None), (5, "", "s1"), (7, "a b", None), (7, "a b", None), (900, "x " * 50000, "big")]
    return rows, spark.createDataFrame([(*r, "q", "z") for r in rows], SCHEMA).repartition(3)


def test_budgets(spark):
    rows, docs = frame(spark)
    s = m.Settings(entropy=0.9, repeats=1e9)
    got = m.allocate(docs, s).collect()
    assert len(got) == len(rows)
    total = sum(r.n_tokens for r in got)
    weights = {r.source: r.weight for r in got if r.weight}
    h = -sum(w * math.log(w) for w in weights.values())
    assert abs(h - 0.9 * math.log(len(weights))) < 1e-4 and abs(sum(weights.values()) - 1) < 1e-6
    for source, w in weights.items():
        own = [r for r in got if r.source == source]
        drawn = sum(r.copies * r.n_tokens for r in own)
        assert w * total - 2 <= drawn < w * total + max(r.n_tokens for r in own)
        assert max(r.copies for r in own) - min(r.copies for r in own) <= 1


def test_repeat_limit(spark):
    _, docs = frame(spark)
    got = m.allocate(docs, m.Settings(entropy=1.0, repeats=2.0)).collect()
    assert max(r.copies for r in got) <= 3


def test_mix_repeats_rows(spark):
    rows, docs = frame(spark)
    mixed = m.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in m.allocate(docs).collect())


def test_empty(spark):
    _, docs = frame(spark)
    assert m.allocate(docs.limit(0)).collect() == [] and m.mix(docs.limit(0)).collect() == []
