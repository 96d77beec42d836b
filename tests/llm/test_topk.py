import numpy as np

from trackloom.llm import topk as t

SCHEMA = "vec_id long, embedding array<double>, code string, id string"


def brute(rows, k):
    codes = {i: (np.array(v) > 0) for i, v in rows if i is not None and v is not None}
    out = []
    for q in sorted(codes):
        if q % 20 == 0:
            near = sorted((int((codes[q] != c).sum()), i) for i, c in codes.items() if i != q)[:k]
            out += [(q, r + 1, i, d) for r, (d, i) in enumerate(near)]
    return out


def run(spark, rows, k=10):
    df = spark.createDataFrame([(i, v, "a", "b") for i, v in rows], SCHEMA).repartition(3)
    codes = t.codes(df)
    return sorted(map(tuple, t.search(codes, codes.filter("id % 20 = 0"), k).collect()))


def test_against_brute_force(spark):
    rng = np.random.default_rng(0)
    hot = rng.normal(size=64)
    rows = [(k, (hot if k % 3 == 0 else rng.normal(size=64)).tolist()) for k in range(600)] + [(None, hot.tolist()), (1000, None)]
    assert run(spark, rows) == brute(rows, 10)


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, -1.0, 0.0]), (20, [1.0, 1.0, 1.0]), (3, [-1.0, -1.0, -1.0])]
    assert run(spark, rows) == brute(rows, 10)
    assert run(spark, []) == []


def test_index_is_exact():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2**63, (20000, 1)).astype(np.uint64)
    words[:50] = words[0] ^ (np.uint64(1) << rng.integers(0, 64, (50, 1)).astype(np.uint64))
    index = t.SegmentIndex(words)
    for q in (0, 10, 700):
        rows, d, _ = index.search(words[q], 11)
        full = np.bitwise_count(words ^ words[q]).sum(1)
        kth = np.sort(full)[10]
        assert sorted(rows) == sorted(np.flatnonzero(full <= kth))


def test_the_covering_radius_ends_every_query():
    """Near neighbours end at a small radius; among random codes, growth ends where the proof holds, short of all values."""
    rng = np.random.default_rng(2)
    words = rng.integers(0, 2**64, (2000, 1), np.uint64)
    index = t.SegmentIndex(words)
    assert index.segments == 7 and set(np.diff(index.cuts)) == {9, 10}
    for q in range(0, 2000, 50):
        rows, d, r = index.search(words[q], 11)
        assert d.max() < index.segments * (r + 1) and (r == 0 or d.max() >= index.segments * r)
        assert r in (2, 3)
    words[:20] = words[0]
    assert t.SegmentIndex(words).search(words[0], 11)[2] == 0


def test_codes_of_several_lengths(spark):
    rows = [(k, [1.0 if (k >> b) & 1 else -1.0 for b in range(70 if k % 2 else 5)]) for k in range(60)]
    df = spark.createDataFrame([(i, v, "a", "b") for i, v in rows], SCHEMA)
    codes = t.codes(df)
    got = t.search(codes, codes.filter("id % 20 = 0"), 5).collect()
    assert {r.query_id for r in got} == {0, 20, 40} and all(r.id % 2 == 0 for r in got)
