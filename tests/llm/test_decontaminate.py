import hashlib
import re

import pytest

from trackloom.llm import decontaminate as d

LOW = str.maketrans(d.AZ, d.LOW)
SCHEMA = "doc_id long, text string, k1 string, row string, __row string"
ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (10, "Short Item"), (2, "--"), (3, None), (9, "ÀB àb x"), (4, "q " * 13)]


def words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW)) if w]


def brute(text):
    own, hit, items = words(text), set(), set()
    for item, t in ITEMS:
        it = words(t)
        n = min(13, len(it))
        wins = {tuple(it[k : k + n]) for k in range(len(it) - n + 1)} if n else set()
        for k in range(len(own) - n + 1) if n else ():
            if tuple(own[k : k + n]) in wins:
                hit |= set(range(k, k + n))
                items.add(str(item))
    names = ",".join(sorted(items))
    return len(own), len(hit), len(items), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(own)


TEXTS = [None, "", "...", ITEMS[0][1], "x " + ITEMS[0][1].upper() + "!", "a SHORT-item b short", "Àb àB x àb àb x", "ÀB àb X", "q " * 40, "w " * 5000 + "short item", ITEMS[0][1][4:], ITEMS[0][1] + "\nshort\x00item"]


def frame(spark):
    rows = [(k, x, "a", "b", "c") for k, x in enumerate(TEXTS)] + [(None, TEXTS[5], "a", "b", "c"), (5, TEXTS[5], "a", "b", "c")]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def items(spark):
    return spark.createDataFrame([(*r, "z") for r in ITEMS], "item_id long, text string, h string")


@pytest.mark.parametrize("part", [d.SET_PART, 2])
def test_against_brute_force(spark, part):
    rows, docs = frame(spark)
    got = d.report(docs, items(spark), set_part=part).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(((r[0], *brute(r[1])) for r in rows), key=str)
    kept = d.remove_documents(docs, items(spark), set_part=part)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not brute(r[1])[4] for r in rows)


def test_remove_spans(spark):
    _, docs = frame(spark)
    got = {r.doc_id: r.text for r in d.remove_spans(docs, items(spark)).filter("doc_id in (1, 4, 5, 6)").collect()}
    assert got[4] == "x!" and got[5] == "a b short" and got[6] == " àb àb x"
    assert got[1] == ""


def test_hits_of_different_length_overlap(spark):
    from pyspark.sql import functions as F

    rows = [([(1, 13), (2, 2), (9, 13), (15, 1), (30, 2)],), ([(5, 1), (6, 1)],), ([],)]
    df = spark.createDataFrame(rows, "hits array<struct<at:int,n:int>>").select(d.n_hit().alias("n"), F.flatten(F.transform(d.covered(), lambda x: F.concat(F.array_repeat(F.lit(0), x["gap"]), F.array_repeat(F.lit(1), x["run"])))).alias("m"))
    got = df.collect()
    for (h,), r in zip(rows, got):
        inside = {k for a, n in h for k in range(a, a + n)}
        assert r.n == len(inside) and [k + 1 for k, x in enumerate(r.m) if x] == sorted(inside)


def test_empty(spark):
    _, docs = frame(spark)
    assert d.report(docs.limit(0), items(spark)).collect() == []
    assert {r.n_hit for r in d.report(docs, items(spark).limit(0)).collect()} == {0}
