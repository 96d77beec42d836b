import numpy as np

from trackloom.llm import substring_dedup as s

SCHEMA = "doc_id long, text string, key string, did string"


def brute(rows):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        d = s.NULL_ID if d is None else d
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, t in rows:
        b, gone = (t or "").encode(), set()
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < (s.NULL_ID if d is None else d):
                gone |= set(range(k, k + 50))
        kept = bytes(x for k, x in enumerate(b) if k not in gone)
        spans = sum(k in gone and k - 1 not in gone for k in range(len(b)))
        out.append((d, len(b), len(gone), spans, s.sha256(kept)))
    return sorted(out, key=str)


def corpus():
    rng = np.random.default_rng(0)
    text = lambda n: "".join(rng.choice(list("abcdefé \n"), n))
    passages = [text(int(n)) for n in rng.integers(44, 120, 12)]
    rows = []
    for k in range(120):
        parts = [text(int(rng.integers(0, 60))) for _ in range(4)]
        parts.insert(2, passages[int(rng.integers(0, 12))])
        if k % 3 == 0:
            parts.insert(0, passages[int(rng.integers(0, 12))])
        rows.append((int(rng.integers(0, 400)), "".join(parts)))
    rows += [(500 + k, rows[3][1]) for k in range(30)] + [(600, None), (601, ""), (None, rows[9][1]), (602, "a" * 3000), (603, "a" * 49), (604, "a" * 50), (605, rows[3][1][:60]), (7, rows[3][1]), (7, rows[3][1]), (-5, rows[8][1]), (-9, rows[8][1][:70] + "tail"), (606, "b" * 25 + "\0" * 60), (607, "b" * 25 + "\0" * 59 + "c")]
    return rows


def run(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(5)
    return sorted(map(tuple, s.digest(s.remove_repeats(docs, **options)).collect()), key=str)


def test_against_brute_force(spark):
    rows = corpus()
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


def test_equal_strings_share_an_anchor():
    rng = np.random.default_rng(1)
    for _ in range(50):
        w = rng.integers(97, 101, 50, np.uint8).tobytes()
        a, b = (rng.integers(97, 101, int(n), np.uint8).tobytes() for n in rng.integers(0, 90, 2))
        text, at, name = s.anchors([a + w + b, b + w + a])
        inside = [{(p - lead, h) for t, p, h in zip(text, at, name) if t == k and lead <= p <= lead + 25} for k, lead in ((0, len(a)), (1, len(b)))]
        assert inside[0] & inside[1]


def test_strings_of_one_hash_stay_apart():
    around = np.frombuffer(b"".join(bytes([65 + k % 3]) * s.AROUND for k in range(9)), np.uint8).reshape(9, s.AROUND)
    by, new = s._sorted_strings(np.zeros(9, np.uint64), np.arange(9), np.zeros(9, np.int64), around)
    assert [int(around[k, 0]) for k in by] == sorted(around[:, 0].tolist()) and np.flatnonzero(new).tolist() == [0, 3, 6]
