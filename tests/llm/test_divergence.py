import random
import re
from collections import Counter, defaultdict

import numpy as np

from trackloom.llm import divergence as d
from trackloom.llm.common import word_lists

SCHEMA = "doc_id long, text string, lang string, source string, rank string, Part string, terms string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(docs, least=3, top=200):
    seen, held, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in docs:
        lang, source = lang or "", source or ""
        found = TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        seen[lang, source].update(found)
        held[lang].update(set(found))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= least]
        v = len(kept)
        total = {s: sum(seen[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (seen[lang, s][t] + 1) // (total[s] + v) for t in kept} for s in sources}
        q = {t: 1 + 10**9 * (sum(seen[lang, s][t] for s in sources) + 1) // (sum(total.values()) + v) for t in kept}
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if seen[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                for k, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]):
                    out.append((lang, s, part, item, value, k + 1))
    return sorted(out)


def corpus():
    rng = random.Random(3)
    words = ["a", "Ab", "abc", "abd", "b", "été", "étés", "日本", "日", "x9y", "the", "THE", "ñ", "zz-top"]
    docs = [(k, " ".join(rng.choices(words, rng.choices(range(1, 9), k=len(words)), k=rng.randint(0, 40))), rng.choice(["en", "de", None]), f"s{rng.randint(0, 4)}") for k in range(200)]
    docs += [(None, None, "en", "s1"), (1, "", "en", None), (2, "one two", "xx", "only"), (3, "", "yy", "p"), (4, "1 2 3", "yy", "q"), (5, "word " * 30000, "en", "s0")]
    return docs + [(9, "same row over again", "en", "s2")] * 50


def frame(spark, docs):
    return spark.createDataFrame([(*x, "r", "p", "t") for x in docs], SCHEMA)


def test_against_plain(spark, monkeypatch):
    docs = corpus()
    want = plain(docs)
    assert sorted(map(tuple, d.audit(frame(spark, docs).repartition(4)).collect())) == want
    monkeypatch.setattr(d, "FAN", 2)  # several rounds of merging, in narrow ranges
    got = d.audit(frame(spark, docs).repartition(5), d.Settings(range_leaves=4, top=3))
    assert sorted(map(tuple, got.collect())) == [x for x in want if x[2] == "pair" or x[5] <= 3]


def test_empty(spark):
    assert d.audit(frame(spark, [])).collect() == []
    assert d.audit(frame(spark, [(1, None, None, None)])).collect() == []


def leaves(trie):
    out = []
    for row in trie.stretches("x", 0):
        source, n, docs = iter(row["sources"].tolist()), iter(row["n"].tolist()), iter(row["docs"].tolist())
        out += [(t, {row["names"][next(source)]: (next(n), next(docs)) for _ in range(size)}) for t, size in zip(row["terms"], row["sizes"])]
    return out


def test_trie_keeps_byte_order_and_merges(monkeypatch):
    monkeypatch.setattr(d, "LEAVES", 7)
    rng = random.Random(2)
    terms = [bytes(rng.choices(b"ab\xc3\xa9", k=rng.randint(1, 6))) for _ in range(400)]
    trie, want = d.RadixTrie(), defaultdict(lambda: defaultdict(lambda: [0, 0]))
    for k, t in enumerate(terms):
        trie.add([t], f"s{k % 3}", np.array([k]), np.array([1]))
        want[t][f"s{k % 3}"][0] += k
        want[t][f"s{k % 3}"][1] += 1
    plain_leaves = [(t, {s: tuple(c) for s, c in v.items()}) for t, v in sorted(want.items())]
    assert leaves(trie) == plain_leaves and not list(d.RadixTrie().stretches("x", 0))
    both = d.RadixTrie()
    for row in [*trie.stretches("x", 0), *trie.stretches("x", 1)]:
        both.merge(next(d.unpacked([d.packed(row, d.STRETCH)])))
    assert leaves(both) == [(t, {s: (2 * n, 2 * m) for s, (n, m) in v.items()}) for t, v in plain_leaves]


def test_words_come_in_stretches():
    assert list(word_lists("Ab c1d  é f".encode().translate(d.TERM_BYTES), 2)) == [[b"ab", b"c"], [b"d", "é".encode()], [b"f"]]


def test_shares_are_exact():
    for n, of in ((0, 1), (7, 9), (10**13, 10**13 + 5), (123456789012, 8 * 10**15)):
        assert d.share(np.array([n]), of)[0] == 1 + 10**9 * (n + 1) // of
