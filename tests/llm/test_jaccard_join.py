import numpy as np

from trackloom.llm import jaccard_join as j

SCHEMA = "doc_id long, text string, did string, tag string, row string"


def sets(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    n = min(width, len(words))
    return frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1))


def brute(rows, percent=90):
    own = [sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if own[a] and own[b] and 100 * len(own[a] & own[b]) >= percent * len(own[a] | own[b]):
                root[find(a)] = find(b)
    ids = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(k)] = min(ids.get(find(k), d), d)
    return sorted(((d, len(own[k]), ids.get(find(k))) for k, (d, _) in enumerate(rows)), key=str)


def corpus(seed=0):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    rows, doc = [], 0
    for size in (1, 2, 3, 5, 9, 11, 12, 20, 40, 80, 200, 400):
        for _ in range(3):
            text = [word() for _ in range(size)]
            for _ in range(9):
                copy = list(text)
                for _ in range(int(rng.integers(0, max(2, size // 25))) if len(copy) > 1 else 0):
                    k = int(rng.integers(0, max(1, len(copy))))
                    copy[k : k + int(rng.integers(0, 2))] = [word()] * int(rng.integers(0, 2))
                rows.append((doc, " ".join(copy)))
                doc += 1
                if rng.random() < 0.3:  # a chain: later copies derive from this one
                    text = copy
    rows += [(None, rows[100][1]), (doc, None), (doc + 1, " \t"), (doc + 2, ""), (5, rows[5][1].upper()), (doc + 3, "x y z " * 9000)]
    return rows


def run(spark, rows):
    docs = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, j.report(docs).collect()), key=str)


def test_against_brute_force(spark):
    rows = corpus()
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


def left(elements, percent, crowded):
    """Signatures after the document's most crowded ones are left out; ``crowded`` ranks any signature."""
    sigs, kinds = j.signatures(elements, percent)
    keep = set(sigs[kinds >= j.DELETION].tolist())
    for k in np.unique(kinds[kinds < j.DELETION]):
        own = sorted(sigs[kinds == k].tolist(), key=crowded)
        keep |= set(own[j._crowds(percent)[k] :])
    return keep


def test_signatures_lose_no_link():
    """Every linked pair shares a signature that neither leaves out, over sizes around the bands' ends."""
    rng = np.random.default_rng(2)
    missed = linked = 0
    for percent in (80, 90):
        for _ in range(3000):
            size = int(rng.integers(1, 160))
            a = rng.integers(0, 2**63, size).astype(np.uint64)
            drop = int(rng.integers(0, size * (100 - percent) // 100 + 2))
            b = np.concatenate([a[min(drop, size - 1) :], rng.integers(0, 2**63, int(rng.integers(0, size // 12 + 1))).astype(np.uint64)])
            a, b = np.unique(a), np.unique(b)
            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * (len(a) + len(b) - both) and len(a) + len(b) > 2 * both:
                linked += 1
                # the worst ranking: what the two share is more crowded than the rest
                common = set(j.signatures(a, percent)[0].tolist()) & set(j.signatures(b, percent)[0].tolist())
                crowded = lambda s: (s not in common, s)
                missed += not left(a, percent, crowded) & left(b, percent, crowded)
    assert linked > 600 and missed == 0


def test_sketches_pass_every_link():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a, b = (rng.integers(0, 400, int(rng.integers(1, 300))).astype(np.uint64) for _ in range(2))
        a, b = np.unique(a), np.unique(b)
        x, y = j.sketch(a), j.sketch(b)
        n = min(len(x), len(y))
        assert np.bitwise_count(j.folded(x, n) ^ j.folded(y, n)).sum() <= len(np.setxor1d(a, b))


def test_crowded_buckets(spark, monkeypatch):
    """Copies of one text with ever more changes: most pairs are near the threshold and unlinked, and buckets hold all."""
    rng = np.random.default_rng(4)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(160):
        text = list(base)
        for at in rng.choice(120, int(rng.integers(0, 9)), replace=False):
            text[at] = f"x{k}-{at}"
        rows.append((k, " ".join(text)))
    monkeypatch.setattr(j, "BLOCK", 40)
    assert run(spark, rows) == brute(rows)


def test_keep_one(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "A b c d"), (None, "x y z"), (None, "p q r"), (3, ""), (4, None), (4, None), (5, "x y z"), (6, "\x0b ")]
    docs = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)
    got = j.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, "a b c d"), (None, "p q r"), (3, ""), (4, None), (4, None), (5, "x y z"), (6, "\x0b ")], key=str)
