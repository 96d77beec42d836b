import numpy as np

from trackloom.llm import line_dedup as d

SCHEMA = "doc_id long, text string, n_lines string, k1 string"


def brute(rows, n=10):
    blanks = " \t\n\x0b\x0c\r"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(blanks).translate(low)
    seen = {}
    for _, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            seen[k] = seen.get(k, 0) + 1
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        keep = [x for x in lines if not key(x) or seen[key(x)] < n]
        out.append((doc, len(lines), len(lines) - len(keep), d.sha256("\n".join(keep).encode())))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA).repartition(3)


def run(spark, rows, **options):
    docs = frame(spark, rows)
    return sorted(map(tuple, d.digest(d.LineStore(spark, **options).insert(docs).apply(docs)).collect()), key=str)


def cases():
    rng = np.random.default_rng(3)
    common = ["Share This", " share this\t", "ÀB", "àb", "x", "", "  "]
    rows = [(k, "\n".join([f"own {k}", *rng.choice(common, 4), f"pair {k // 2}", f"tens {k // 10}"])) for k in range(60)]
    rows += [(None, None), (None, "x"), (61, ""), (62, "\n\n"), (62, "\n\n"), (63, "x\r\nx"), (64, "long line " * 20000 + "\nShare this")]
    return rows


def test_against_brute_force(spark):
    rows = cases()
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, shard_keys=1) == brute(rows)


def test_many_cells(spark):
    rows = cases()
    docs = frame(spark, rows)
    store = d.LineStore(spark, shards=2).insert(docs)
    assert sorted(map(tuple, d.digest(store.apply(docs, cell_bytes=10_000)).collect()), key=str) == brute(rows)


def test_deletion_restores_the_state(spark):
    rows = cases()
    store = d.LineStore(spark).insert(frame(spark, rows[:40])).insert(frame(spark, rows[40:])).delete(frame(spark, rows[:30]))
    want = d.LineStore(spark).insert(frame(spark, rows[30:]))
    assert sorted(map(tuple, store.counts.collect())) == sorted(map(tuple, want.counts.collect()))
    # the filters hold what the counts say: keys that fell below the threshold were deleted from them
    held = {r.shard: r.keys for r in store.filters.collect() if r.keys}
    assert held == {r.shard: r.keys for r in want.filters.collect() if r.keys}
    marks = lambda x: {r.shard: sorted(np.frombuffer(r.slots, np.uint16)[np.frombuffer(r.slots, np.uint16) > 0].tolist()) for r in x.filters.collect() if r.keys}
    assert marks(store) == marks(want)
    got = d.digest(store.apply(frame(spark, rows[30:]))).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows[30:])


def test_empty_table(spark):
    assert run(spark, []) == []


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    keys = rng.integers(-(2**63), 2**63, (3000, 2), np.int64)
    f = d.CuckooFilter.build(keys[:2000, 0], keys[:2000, 1])
    assert f.contains(keys[:2000, 0], keys[:2000, 1]).all()
    assert f.contains(keys[2000:, 0], keys[2000:, 1]).mean() < 0.02
    f.delete(keys[:1000, 0], keys[:1000, 1])
    assert f.contains(keys[1000:2000, 0], keys[1000:2000, 1]).all()
    assert f.contains(keys[:1000, 0], keys[:1000, 1]).mean() < 0.02
