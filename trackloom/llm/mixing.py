"""Mixing sources to target weights: temperature, bisected, realised as budgeted block permutations. DataFrame functions
only.

Source shares p of the tokens become weights proportional to p**t. The exponent t is bisected to the largest one whose
weights reach the target entropy, then raised, if need be, to the smallest at which no source is repeated more often than
allowed. A source's budget is so many whole passes and a part of one. A pass visits the source's blocks (documents of one
hash prefix) in the order of a seeded hash of the block; the last block's documents follow their own hashes until the
budget is reached.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import Scratch


@dataclass(frozen=True)
class Settings:
    """``entropy``: target as a share of the largest possible, ln(sources). ``repeats``: passes over a source at most.
    ``budget``: tokens to draw as a share of those there are. ``digits``: hex digits of a block's hash prefix."""

    entropy: float = 0.95
    repeats: float = 4.0
    budget: float = 1.0
    digits: int = 3
    steps: int = 30
    seed: str = "mix"


def token_count(text: Column) -> Column:
    """Runs of characters other than blank, tab, line feed and carriage return."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\n\r]+")).cast("long")


def _fold(values: Column, f) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, p: acc + f(p))


def exponent(shares: Column, total: Column, settings: Settings) -> Column:
    """The exponent for an array of shares (sum 1, all over 0) of ``total`` tokens."""
    s = settings
    norm = lambda t: _fold(shares, lambda p: F.pow(p, t))

    def entropy(t):
        z = norm(t)
        return -_fold(shares, lambda p: F.pow(p, t) / z * F.ln(F.pow(p, t) / z))

    def repeats(t):
        # weight * budget / tokens = p**t / z * budget / p, largest over the sources
        z = norm(t)
        return F.aggregate(shares, F.lit(0.0), lambda acc, p: F.greatest(acc, F.pow(p, t) / z * F.lit(s.budget) / p))

    def bisect(fine, keep_low: bool):
        def step(acc, _):
            mid = (acc["lo"] + acc["hi"]) / 2
            good = fine(mid)
            up = good if keep_low else ~good
            return F.struct(F.when(up, mid).otherwise(acc["lo"]).alias("lo"), F.when(up, acc["hi"]).otherwise(mid).alias("hi"))

        end = F.aggregate(F.sequence(F.lit(1), F.lit(s.steps)), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), step)
        return end["lo"] if keep_low else end["hi"]

    by_entropy = bisect(lambda t: entropy(t) >= s.entropy * F.ln(F.size(shares)), True)
    by_repeats = F.when(repeats(F.lit(0.0)) <= s.repeats, 0.0).otherwise(bisect(lambda t: repeats(t) <= s.repeats, False))
    return F.greatest(by_entropy, by_repeats)


def source_budgets(counted: DataFrame, settings: Settings) -> DataFrame:
    """``__source, weight, tokens, passes, rest`` from ``__source, __tokens``: one row for each source with tokens. The
    sources, not the documents, meet in one row for the bisection."""
    s = settings
    sums = counted.groupBy("__source").agg(F.sum("__tokens").alias("tokens")).filter("tokens > 0")
    one = sums.agg(F.sort_array(F.collect_list(F.struct("__source", "tokens"))).alias("all"), F.sum("tokens").alias("total"))
    one = one.withColumn("shares", F.transform("all", lambda x: x["tokens"] / F.col("total")))
    one = one.withColumn("t", exponent(F.col("shares"), F.col("total"), s))
    one = one.withColumn("z", _fold(F.col("shares"), lambda p: F.pow(p, F.col("t"))))
    rows = one.select("total", "t", "z", F.explode("all").alias("a")).select("total", "t", "z", "a.*")
    weight = F.round(F.pow(F.col("tokens") / F.col("total"), F.col("t")) / F.col("z"), 9)
    due = F.floor(weight * F.col("total") * s.budget).cast("long")
    rows = rows.select("__source", weight.alias("weight"), "tokens", due.alias("due"))
    passes = F.floor(F.col("due") / F.col("tokens")).cast("long")
    return rows.select("__source", "weight", "tokens", passes.alias("passes"), (F.col("due") - passes * F.col("tokens")).alias("rest"))


def drawn(docs: DataFrame, settings: Settings, *keep: Column) -> DataFrame:
    """``keep`` columns of ``docs`` as ``row``, and ``__tokens, weight, copies`` of each row.

    A null source is a source of its own. Documents without tokens come once each with every whole pass, never in part.
    Null doc_ids and repeated rows are rows like others; ties in a block are ordered by doc_id, tokens and text. An empty
    table stays empty. Whole blocks are drawn or left by a row for each source, so texts are not moved; only the one block of
    each source that is entered in part has its rows ordered. A source's blocks grow with ``digits``.
    """
    s = settings
    scratch = Scratch(docs.sparkSession, "mixing")
    hashed = F.md5(F.concat(F.lit(s.seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    source = F.coalesce(F.concat(F.lit("s:"), F.col("source")), F.lit("null"))
    rows = docs.select(F.struct(*keep).alias("row"), source.alias("__source"), token_count(F.col("text")).alias("__tokens"), hashed.alias("__hash"), F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__text"))
    rows = rows.withColumn("__block", F.substring("__hash", 1, s.digits))
    blocks = scratch.save(rows.groupBy("__source", "__block").agg(F.sum("__tokens").alias("n")), "counts")
    budgets = scratch.save(source_budgets(blocks.withColumnRenamed("n", "__tokens"), s), "budgets")
    order = F.md5(F.concat(F.lit(s.seed + "/"), "__source", F.lit("/"), "__block"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("__source").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("before", before).join(budgets, "__source").withColumn("left", F.col("rest") - F.col("before"))
    # blocks are drawn whole up to the first that the budget does not hold, so a source needs no more than that one's place
    ends = blocks.filter(~((F.col("left") > 0) & (F.col("left") >= F.col("n")))).groupBy("__source").agg(F.min(F.struct(order.alias("order"), "left")).alias("end"))
    sources = scratch.save(budgets.join(ends, "__source").select("__source", "weight", "passes", F.col("end.order").alias("order"), F.col("end.left").alias("left")), "sources")
    placed = rows.withColumn("__order", order).join(sources, "__source", "left")
    partly = F.coalesce((F.col("__order") == F.col("order")) & (F.col("left") > 0), F.lit(False))
    more = F.when(F.col("__order") < F.col("order"), 1).otherwise(0)
    whole = placed.filter(~partly).select("row", "__tokens", "weight", (F.coalesce("passes", F.lit(1)) + more).alias("copies"))
    # one block for each source at most is entered in part
    w = Window.partitionBy("__source", "__block").orderBy("__hash", "__id", "__tokens", "__text").rowsBetween(Window.unboundedPreceding, -1)
    run = F.coalesce(F.sum("__tokens").over(w), F.lit(0))
    part = placed.filter(partly).withColumn("run", run).select("row", "__tokens", "weight", (F.col("passes") + F.when(F.col("run") < F.col("left"), 1).otherwise(0)).alias("copies"))
    return whole.union(part)


def allocate(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, source, n_tokens, weight, copies``: how often each document is drawn; rows of every kind as in
    :func:`drawn`, a very long text counted whole, other columns ignored."""
    rows = drawn(docs, settings, F.col("doc_id"), F.col("source"))
    return rows.select("row.doc_id", "row.source", F.col("__tokens").alias("n_tokens"), F.coalesce("weight", F.lit(0.0)).alias("weight"), F.col("copies").cast("long").alias("copies"))


def mix(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` with each row repeated as often as it is drawn. All columns stay, whatever their names; null sources, ids and
    texts, empty texts, ties, repeated rows and an empty table are as in :func:`drawn`; a very long text is one row that may
    end its source's budget late."""
    rows = drawn(docs, settings, F.col("*"))
    return rows.filter("copies > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")
