"""Benchmark decontamination by a broadcast hash set of normalised n-grams; DataFrame functions only.

The distinct hashes of the benchmark's windows are the hash set, a broadcast join's build side. A document's windows are
hashed in place and probe it as rows (text key, position, hash) that no exchange carries; only the probable hits go on, with
their words, to be verified against the benchmark's windows. A set of more than ``set_part`` hashes is probed in parts of
that size by a slice of the hashes, so what is broadcast at once is bounded at any size of the benchmark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import Scratch

AZ, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: Hashes that are broadcast at once, some 40 MB of them.
SET_PART = 1_000_000


def lower_az(text: Column) -> Column:
    """A-Z lower-cased and nothing else; pure ASCII takes the fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, AZ, LOW))


def words(text: Column) -> Column:
    """Maximal runs of ASCII letters, digits and non-ASCII characters, lower-cased in A-Z; none for null."""
    return F.filter(F.split(lower_az(F.coalesce(text, F.lit(""))), GAPS), lambda w: w != "")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item_id, n, h, w``: the distinct windows of every item, blank-joined as ``w``, of ``n`` words, with their hash; a
    short item is one window, a null or wordless one has none."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    items = items.withColumn("n", F.least(F.size("words"), F.lit(window)))
    starts = F.sequence(F.lit(1), F.size("words") - F.col("n") + 1)
    cut = items.select("item_id", "n", F.explode(F.transform(starts, lambda i: F.slice("words", i, F.col("n")))).alias("w")).distinct()
    h = F.coalesce(*(F.when(F.col("n") == n, F.xxhash64(*(F.get("w", F.lit(k)) for k in range(n)))) for n in range(1, window + 1)))
    return cut.select("item_id", "n", h.alias("h"), F.array_join("w", " ").alias("w"))


def text_keys() -> list[Column]:
    """128 bits that stand for a text; equal texts have equal hits."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def hits(docs: DataFrame, windows: DataFrame, set_part: int = SET_PART) -> DataFrame:
    """``k1, k2, n_words, hits, items`` for each different text with a window of the benchmark in it: ``hits`` are structs (at, n) by
    ``at``, from 1, the longest of each; ``items`` the sorted item_ids."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    windows = scratch.save(windows, "windows")
    known = scratch.save(windows.select("n", "h").distinct(), "set")
    parts = max(1, -(-known.count() // set_part))
    sizes = sorted(r.n for r in known.select("n").distinct().collect())  # as many as a window has words, at most
    # each position is a row with the document's own array beside it, and its hashes are compiled code; nothing is copied
    cut = docs.select(*text_keys(), words(F.col("text")).alias("words"))
    probed = None
    if sizes:
        starts = F.when(F.size("words") >= sizes[0], F.sequence(F.lit(1), F.size("words") - (sizes[0] - 1)))
        probed = cut.select("k1", "k2", "words", F.explode(starts).alias("at"))
        hashes = [F.when(F.size("words") - F.col("at") >= n - 1, F.xxhash64(*(F.get("words", F.col("at") + (k - 1)) for k in range(n)))) for n in sizes]
        if len(sizes) == 1:
            probed = probed.select("k1", "k2", "words", "at", F.lit(sizes[0]).alias("n"), hashes[0].alias("h"))
        else:
            each = F.explode(F.array(*(F.struct(F.lit(n).alias("n"), h.alias("h")) for n, h in zip(sizes, hashes))))
            probed = probed.select("k1", "k2", "words", "at", each.alias("p")).select("k1", "k2", "words", "at", "p.*")
    found = None
    for k in range(parts):
        own = known if parts == 1 else known.filter(F.pmod("h", F.lit(parts)) == k)
        if probed is not None:
            hit = probed.join(F.broadcast(own), ["n", "h"])
            hit = hit.select("k1", "k2", F.size("words").cast("long").alias("n_words"), "at", "n", "h", F.array_join(F.slice("words", F.col("at"), F.col("n")), " ").alias("w"))
            found = hit if found is None else found.union(hit)
    if found is None:
        return docs.sparkSession.createDataFrame([], "k1 long, k2 long, n_words long, hits array<struct<at:int,n:int>>, items array<string>")
    places = found.groupBy("k1", "k2", "n_words", "n", "h", "w").agg(F.collect_set("at").alias("ats"))
    owners = windows.groupBy("n", "h", "w").agg(F.collect_set("item_id").alias("owners"))
    true = places.join(owners, ["n", "h", "w"])
    spans = F.transform("ats", lambda x: F.struct(x.alias("at"), F.col("n").alias("n")))
    all_ = true.groupBy("k1", "k2", "n_words").agg(F.array_sort(F.flatten(F.collect_list(spans))).alias("all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("owners")))).alias("items"))
    longest = F.filter("all", lambda x, k: F.coalesce(F.get("all", k + 1)["at"] != x["at"], F.lit(True)))
    return scratch.save(all_.select("k1", "k2", "n_words", longest.alias("hits"), "items"), "hits")


def covered(window: int = WINDOW) -> Column:
    """``hits`` as structs (gap, run): words that none covers before a hit, and those that it covers first."""
    # hits start at different words, so one that is ``window`` places earlier in the array has ended
    ends = lambda k: F.array_max(F.transform(F.filter(F.sequence(k - window, k - 1), lambda q: q >= 0), lambda q: F.get("hits", q)["at"] + F.get("hits", q)["n"]))

    def piece(x: Column, k: Column) -> Column:
        before = F.coalesce(ends(k), F.lit(1))
        return F.struct(F.greatest(x["at"] - before, F.lit(0)).alias("gap"), F.greatest(x["at"] + x["n"] - F.greatest(x["at"], before), F.lit(0)).alias("run"))

    return F.transform("hits", piece)


def n_hit(window: int = WINDOW) -> Column:
    """Words inside any hit window."""
    return F.coalesce(F.aggregate(covered(window), F.lit(0), lambda acc, x: acc + x["run"]), F.lit(0)).cast("long")


def is_contaminated(share: int) -> Column:
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))


def judged(docs: DataFrame, benchmark: DataFrame, window: int, set_part: int) -> DataFrame:
    """``k1, k2, n_words, n_hit, items`` of the texts that are hit."""
    return hits(docs, benchmark_windows(benchmark, window), set_part).select("k1", "k2", "n_words", n_hit(window).alias("n_hit"), "items")


def report(docs: DataFrame, benchmark: DataFrame, share: int = 20, window: int = WINDOW, set_part: int = SET_PART) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for each row of ``docs``; contaminated: one word in
    ``share`` or more is hit.

    A null text has no words. Null doc_ids and repeated rows keep a row each; very long texts are probed whole; other
    columns are ignored; an empty table gives an empty result, an empty benchmark hits nothing.
    """
    rows = docs.select("doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"), *text_keys())
    rows = rows.join(judged(docs, benchmark, window, set_part).drop("n_words"), ["k1", "k2"], "left").withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long")))
    items = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), is_contaminated(share).alias("contaminated")
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, share: int = 20, window: int = WINDOW, set_part: int = SET_PART) -> DataFrame:
    """``docs`` without contaminated documents. All columns stay, whatever their names; null and empty texts, null ids and
    repeated rows stay; very long texts are probed whole; an empty table or benchmark removes nothing."""
    gone = judged(docs, benchmark, window, set_part).filter(is_contaminated(share)).select("k1", "k2")
    held = docs.select(F.struct("*").alias("row"), *text_keys())
    return held.join(gone, ["k1", "k2"], "left_anti").select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, set_part: int = SET_PART) -> DataFrame:
    """``docs`` with the hit words and what separates them from the word before cut from ``text``. Other columns, whatever
    their names, and untouched texts, null and empty ones with them, stay as they are; repeated rows are cut alike; the work
    on a very long text grows with its words."""
    found = hits(docs, benchmark_windows(benchmark, window), set_part).select("k1", "k2", covered(window).alias("pieces"))
    held = docs.select(F.struct("*").alias("row"), "text", *text_keys()).join(found, ["k1", "k2"], "left")
    # the text as (gap, word) pieces, then whatever follows the last word
    piece = r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"
    tail = F.regexp_extract("text", r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)\z", 1)
    gone = F.flatten(F.transform("pieces", lambda x: F.concat(F.array_repeat(F.lit(False), x["gap"]), F.array_repeat(F.lit(True), x["run"]))))
    held = held.withColumn("gone", gone).withColumn("words", F.regexp_extract_all("text", F.lit(piece), F.lit(1)))
    kept = F.array_join(F.filter("words", lambda x, k: ~F.coalesce(F.get("gone", k), F.lit(False))), "")
    cut = F.when(F.col("pieces").isNotNull(), F.concat(kept, tail)).otherwise(F.col("text"))
    return held.withColumn("cut", cut).select(F.col("row").withField("text", F.col("cut")).alias("row")).select("row.*")
