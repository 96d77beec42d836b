"""Personal data by candidate gradient boosting.

Base rules find the well-formed cases. Beside them, generators of high recall propose overlapping spans that the rules
cannot settle (two card numbers in one run of digits, national phone numbers, defanged addresses, "name at host dot tld"),
boosted trees score each from features of its form and context, thresholds calibrated for precision select, and the best
of overlapping selections is kept. Base spans always stay.

The trees are fitted on the driver from labelled examples that a seeded generator writes (``examples`` is the bound).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import small_batches

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only start at the first digit of a run, so the run is never entered in its middle
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, x in enumerate(reversed(digits)):
        v = ord(x) - 48
        if k % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the rules' matches in code points, sorted."""
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in IP.finditer(text):
        if all(len(x := p.lstrip("0")) <= 3 and (not x or int(x) <= 255) for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


CLUSTER = re.compile(r"[+(]?[0-9][0-9 ().\-/\[\]]{5,}[0-9]")
GROUP = re.compile(r"[0-9]+")
AT = re.compile(r" ?(?:\(at\)|\[at\]|@) ?| at ", re.I)
# names in the DNS have 63 characters at most, local parts 64; longer ones are no addresses
HOST = re.compile(r"[A-Za-z0-9-]{1,63}+(?: ?(?:\(dot\)|\[dot\]|\.| dot ) ?[A-Za-z0-9-]{1,63}+)++", re.I)
WORDS = {
    "email": ("mail", "e-mail", "contact", "correo", "courriel", "write", "kontakt"),
    "ip": ("ip", "host", "server", "address", "adresse", "addr"),
    "card": ("card", "visa", "karte", "carte", "tarjeta", "mastercard", "payment", "cc"),
    "phone": ("tel", "phone", "call", "mobile", "fax", "telefon", "teléfono", "cell"),
    "other": ("order", "isbn", "version", "invoice", "serial", "ref", "id", "no", "build", "date", "page", "article"),
}


def candidates(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, kind number, end) of everything that might be personal data beyond the rules; spans overlap. Windows hold
    19 digits at most, the most that a card or phone number has, which bounds the spans of a text by its length; what fails
    Luhn's test is no card. Local parts of addresses have 64 characters at most, labels of hosts 63, as the standards say."""
    for m in AT.finditer(text):
        start = m.start()
        while start > 0 and m.start() - start <= 64 and text[start - 1] in LOCAL:
            start -= 1
        found = HOST.match(text, m.end()) if m.start() - 64 <= start < m.start() else None
        if found:
            yield start, 0, found.end()
    for m in CLUSTER.finditer(text):
        groups = [(m.start() + g.start(), m.start() + g.end()) for g in GROUP.finditer(m.group())]
        for i, (a, first_end) in enumerate(groups):
            digits = 0
            for j in range(i, len(groups)):
                digits += groups[j][1] - groups[j][0]
                if digits > 19:
                    break
                b = groups[j][1]
                if digits >= 13 and luhn(re.sub("[^0-9]", "", text[a:b])):
                    yield a, 2, b
                if 7 <= digits <= 15:
                    yield a - (text[a - 1 : a] in ("+", "(")), 3, b
                if j == i + 3 and digits <= 12 and b - a <= digits + 9:
                    yield a, 1, b


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    """Form of the span and of its surroundings."""
    s = text[start:end]
    digits = [x for x in s if "0" <= x <= "9"]
    groups = [len(g) for g in re.split(r"[^0-9]+", s) if g]
    values = [int(g) for g in re.split(r"[^0-9]+", s) if g and len(g) < 5]
    before, after = text[max(0, start - 24) : start].lower(), text[end : end + 2]
    near = re.split(r"[^\w-]+", before)[-4:]
    row = [kind, len(digits), len(groups), max(groups, default=0), min(groups, default=0), float(luhn("".join(digits)) if 12 < len(digits) < 20 else -1)]
    row += [s.count(x) for x in " -./("] + [s.count(")") == s.count("("), s[:1] == "+", s[:1] == "0", s[:2] == "00", "@" in s]
    row += [max(values, default=0) <= 255 and len(values) == len(groups), len(set(digits)), s[:1] in "3456" if s else False]
    row += [any(w in near for w in WORDS[k]) for k in WORDS]
    row += [before[-1:].isdigit(), before[-1:].isalpha(), before[-1:] in (".", "-", "/", "+"), after[:1].isdigit(), after[:1].isalpha(), after[:1] in ("-", "/") or (after[:1] == "." and after[1:].isdigit())]
    row += [text[max(0, start - 2) : start - 1].isdigit() and before[-1:] in " -.", after[1:].isdigit() and after[:1] in (" ", "-", "."), len(set(groups)) == 1, max(0, end - start - len(digits))]
    return [float(x) for x in row]


@dataclass
class Trees:
    """Boosted trees of fixed depth: ``feature`` and ``cut`` by node, ``leaf`` values; level order."""

    depth: int
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    bias: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        y = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            y += v[node - (1 << self.depth) + 1]
        return 1 / (1 + np.exp(-y))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, ridge: float = 1.0) -> Trees:
    """Newton boosting on the logistic loss over histogram splits."""
    n, m = x.shape
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], 1)
    bias = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    raw, nodes = np.full(n, bias), (1 << depth) - 1
    feature, cut, leaf = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p) + 1e-9
        f, c, place = np.zeros(nodes, np.int64), np.full(nodes, np.inf), np.zeros(n, np.int64)
        for node in range(nodes):
            at = np.flatnonzero(place == node)
            best = 1e-6
            for k in range(m if len(at) > 8 else 0):
                own = bins[at, k]
                gs, hs = np.cumsum(np.bincount(own, g[at], 34)), np.cumsum(np.bincount(own, h[at], 34))
                gain = gs**2 / (hs + ridge) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + ridge) - gs[-1] ** 2 / (hs[-1] + ridge)
                b = int(np.argmax(gain[: len(cuts[k])]))
                if gain[b] > best:
                    best, f[node], c[node] = gain[b], k, cuts[k][b]
            place[at] = 2 * node + 1 + (x[at, f[node]] > c[node])
        v = np.zeros(nodes + 1)
        for k in range(nodes + 1):
            at = place == nodes + k
            v[k] = rate * g[at].sum() / (h[at].sum() + ridge)
        raw += v[place - nodes]
        feature.append(f)
        cut.append(c)
        leaf.append(v)
    return Trees(depth, np.array(feature), np.array(cut), np.array(leaf), bias)


def _card(rng) -> str:
    body = "".join(map(str, rng.integers(0, 10, 15)))
    body = str(rng.integers(3, 7)) + body[1:]
    return next(body + str(k) for k in range(10) if luhn(body + str(k)))


def labelled_examples(count: int, seed: int) -> Iterator[tuple[str, int, int, int, int]]:
    """(text, start, kind number, end, label) of generated candidates: what the generators propose over a written case is
    labelled by whether it is a planted span."""
    rng = np.random.default_rng(seed)
    some = lambda *x: x[int(rng.integers(len(x)))]
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    pairs = lambda n: " ".join(number(2) for _ in range(n))
    word = lambda: "".join(rng.choice(list("abdehilnorstu"), int(rng.integers(2, 9))))
    for _ in range(count):
        kind = int(rng.integers(0, 8))
        cue = ""
        if kind == 0:
            s = f"{word()}{some('.', '')}{word()}{some(' at ', ' (at) ', '(at)', '[at]', ' @ ')}{word()}{some(' dot ', ' (dot) ', '[dot]', '(dot)')}{some('com', 'org', 'net', 'de')}"
            s = some(s, s, f"{word()} @ {word()}.{some('com', 'org', 'net')}")
            cue, truth = some("", "mail ", "contact "), 0
            if rng.random() < 0.25:
                s = s.upper()
        elif kind == 1:
            s = some("[.]", " . ").join(str(int(rng.integers(0, 256))) for _ in range(4))
            cue, truth = some("", "server ", "ip ", "host "), 1
        elif kind == 2:
            s, cue, truth = _card(rng), some("", "card ", "visa "), 2
            if rng.random() < 0.5:
                step = some(4, 4, 2)
                s = some(" ", "-", ".").join(s[k : k + step] for k in range(0, 16, step))
        elif kind == 3:
            s = some(f"({number(3)}) {number(3)}-{number(4)}", f"0{number(3)}/{number(7)}", f"00{number(2)} {number(3)} {number(6)}", f"0{number(2)} {number(4)} {number(4)}", f"({number(3)}) 555-{number(4)}", f"{some('00 ', '00')}{number(2)} {some('', '(0)')}{number(1)} {pairs(4)}", f"00 {number(2)} {number(1)} {pairs(4)}", f"0 {number(1)} {pairs(5)}")
            cue, truth = some("", "tel ", "phone ", "call "), 3
        else:
            s = some(f"{rng.integers(1900, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}", f"{number(1)}.{number(2)}.{number(3)}", number(int(rng.integers(8, 26))), f"978-{number(1)}-{number(4)}-{number(4)}-{number(1)}", f"{number(3)} {number(3)} {number(3)}", f"{rng.integers(1, 9)}{number(1)} {pairs(6)}", f"{number(4)}-{number(4)}-{number(4)}-{number(4)}-{number(4)}", f"{number(2)}/{number(2)}/{rng.integers(1900, 2030)} {number(2)}", f"{word()} at {word()}.com dot", f"{number(2)}.{number(2)}.{number(4)} {number(3)}")
            cue, truth = some("", "order ", "isbn ", "version ", "invoice ", "ref ", "no "), -1
        left = f"{word()} {some('', _card(rng) + ' ') if kind == 2 else ''}"
        text = f"{left}{cue}{s}{some(' ', '. ', ', ', chr(10))}{word()}"
        a = text.rindex(s)
        planted = {(a, truth, a + len(s))}
        if kind == 2 and len(left.split()) > 1:  # the card before is one too
            planted.add((left.index(" ") + 1, 2, len(left) - 1))
        for start, k, end in candidates(text):
            hit = (start, k, end) in planted
            if hit or start >= len(left):
                yield text, start, k, end, int(hit)


@dataclass
class Model:
    trees: Trees
    threshold: tuple[float, ...]


def train(examples: int = 6000, precision: float = 0.98, seed: int = 11) -> Model:
    """Fit on three quarters of the examples; on the rest choose, for each kind, the lowest threshold at and above which
    the share of true spans is ``precision``."""
    rows = list(labelled_examples(examples, seed))
    x = np.array([features(*r[:4]) for r in rows])
    y = np.array([r[4] for r in rows], float)
    cut = len(rows) * 3 // 4
    trees = boost(x[:cut], y[:cut])
    p, kind, truth = trees.predict(x[cut:]), x[cut:, 0], y[cut:]
    chosen = []
    for k in range(len(KINDS)):
        own = np.flatnonzero(kind == k)
        own = own[np.argsort(-p[own])]
        good = np.flatnonzero(np.cumsum(truth[own]) / np.arange(1, len(own) + 1) >= precision)
        chosen.append(max(0.5, float(p[own[good[-1]]])) if len(good) else 2.0)
    return Model(trees, tuple(chosen))


def added_spans(text: str, base: list[tuple[int, int, int]], model: Model) -> list[tuple[int, int, int]]:
    """Selected candidates that touch no base span; of overlapping ones the best, then the longest, then the first."""
    starts, ends = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
    # a base span that starts before the candidate's end touches it if the farthest end of those is past its start
    free = [c for c in dict.fromkeys(candidates(text)) if not (k := bisect_left(starts, c[2])) or ends[k - 1] <= c[0]]
    if not free:
        return []
    p = model.trees.predict(np.array([features(text, *c) for c in free]))
    out: list[tuple[int, int, int]] = []
    for k in sorted((k for k, c in enumerate(free) if p[k] >= model.threshold[c[1]]), key=lambda k: (-p[k], free[k][0] - free[k][2], free[k])):
        a, _, b = free[k]
        at = bisect_left(out, (b,))  # chosen spans never overlap, so the one before is the only one to look at
        if not at or out[at - 1][2] <= a:
            out.insert(at, free[k])
    return out


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone`` (base spans), ``base, spans`` (``kind:start:end`` in code points, comma-joined
    by start, then kind) for each row of ``docs``. A null text is empty; null doc_ids and repeated rows keep their rows;
    a very long text is searched whole; other columns are ignored; an empty table gives an empty result. One pass without a
    shuffle."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model or train())
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            counts, bases, alls = [[] for _ in KINDS], [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text)
                for k in range(len(KINDS)):
                    counts[k].append(sum(s[1] == k for s in base))
                bases.append(_join(base))
                alls.append(_join(sorted(base + added_spans(text, base, sent.value))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(bases, pa.string()), pa.array(alls, pa.string())], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {', '.join(f'n_{k} long' for k in KINDS)}, base string, spans string")


def redact(text: str, spans: str, mask: str = "<{}>") -> str:
    """A text with its spans replaced by their kinds; overlapping spans are masked once, by the first."""
    out, done = [], 0
    for s in filter(None, spans.split(",")):
        kind, a, b = s.split(":")
        if int(a) >= done:
            out += [text[done : int(a)], mask.format(kind)]
        done = max(done, int(b))
    return "".join(out) + text[done:]


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(F.encode("base", "UTF-8"), 256).alias("base_sha256"), "spans")
