"""URL filters: explicit rules, and a path-template tree learned per host for the urls that no rule fits.

The tree: below each host, a segment that varies is generalised to a wildcard of its kind, level by level; branches whose
labels are statistically alike are merged; and every template gets a smoothed share of bad labels. Labels are the verdicts
of the rules themselves, so the tree extends what the rules state to look-alike templates of the same host; a host of which
the rules say nothing takes its templates' shares from a tree over all hosts together, where several sites have shown them
to be bad: what is bad on one site alone says nothing of others. Everything works on counts of distinct templates: a hot host
is summed before anything is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import Scratch

#: Host of the tree over all hosts; no host of a url holds a slash.
ALL = "/"
AZ, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


@dataclass(frozen=True)
class Settings:
    """``depth``: levels of the tree, deeper segments are one tail. ``distinct``: literal segments a branch may have
    before they become a wildcard. ``alike``: largest z at which a branch's share of bad counts
    as its parent's; below ``least_rows`` of evidence it always does. ``prior_rows``: weight of
    the parent's share in a template's own. ``unknown_weight``: rows of
    evidence, as not bad, that an unlabelled page is. ``block_at``: share of bad at which the method blocks. ``least_sites``: sites
    on which a template must be bad before it counts on others."""

    depth: int = 4
    distinct: int = 20
    alike: float = 1.96
    least_rows: float = 5.0
    prior_rows: float = 5.0
    unknown_weight: float = 0.5
    block_at: float = 0.5
    least_sites: int = 2


def site_of(host: Column) -> Column:
    """The last two labels of a host; the host where it has no more, or ends in a number."""
    return F.when(host.rlike(r"[0-9]$"), host).otherwise(F.array_join(F.slice(F.split(host, r"\."), -F.least(F.size(F.split(host, r"\.")), F.lit(2)), 2), "."))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    return F.translate(F.regexp_extract(_rest(url), r"(?s)^([^/?#]*)", 1), AZ, LOW)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; null or no ``://``: empty."""
    return F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits; null where none does. A rule fits its host and all subdomains where
    the path starts with the rule's; host and path together measure the length, first listed on ties."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def segments(path: Column, depth: int) -> Column:
    """Path segments below the first slash, each shortened to its kind where it is one of many by its form (numbers,
    hex ids, dates), the ones past ``depth`` as one tail."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/", depth + 1)
    return F.transform(
        parts,
        lambda s: F.when(s.rlike(r"^[0-9]+$"), "{n}")
        .when(s.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), "{date}")
        .when(s.rlike(r"^[0-9a-fA-F]{8,}(-[0-9a-fA-F]+)*$"), "{hex}")
        .when(s.rlike(r"^[^.]*[0-9][^.]*\.[A-Za-z]{2,5}$"), F.concat(F.lit("{n}."), F.element_at(F.split(s, r"\."), -1)))
        .otherwise(s),
    )


def template_tree(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``host, key, template, bad_share`` from ``host, path, verdict`` rows: ``key`` is the segments array of a page.

    One aggregation of the pages; then every level works on the (host, key) table, saved in between so that no level is
    computed twice. At each level a branch whose share of bad differs from its parent's by no more than chance is merged
    into the wildcard ``*``; a branch that differs stays a literal, or, where the parent has too many for that, joins the
    wildcard of its direction. Unlabelled pages count ``unknown_weight`` each as not bad.
    """
    s, scratch = settings, Scratch(pages.sparkSession, "urls")
    rows = pages.select("host", segments(F.col("path"), s.depth).alias("key"), F.when(F.col("verdict") == "block", 1.0).otherwise(0.0).alias("bad"), F.when(F.col("verdict").isNull(), s.unknown_weight).otherwise(1.0).alias("w"), F.col("verdict").isNotNull().cast("long").alias("known"))
    sums = [F.sum("w").alias("w"), F.sum("bad").alias("bad"), F.sum("known").alias("known")]
    own = scratch.save(rows.groupBy("host", "key").agg(*sums), "counts")
    tree = own.unionByName(own.groupBy("key").agg(*sums).withColumn("host", F.lit(ALL))).withColumn("template", F.array().cast("array<string>"))
    tree = scratch.save(tree, "level-0")
    for level in range(s.depth + 1):
        tree = tree.withColumn("segment", F.coalesce(F.get("key", F.lit(level)), F.lit("")))
        branches = tree.groupBy("host", "template", "segment").agg(F.sum("w").alias("w1"), F.sum("bad").alias("b1"))
        parents = tree.groupBy("host", "template").agg(F.sum("w").alias("w0"), F.sum("bad").alias("b0"), F.count_distinct("segment").alias("kinds"))
        share = F.col("b0") / F.col("w0")
        z = (F.col("b1") / F.col("w1") - share) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-6)) / F.col("w1"))
        step = F.when(F.col("segment") == "", "").when((F.abs(z) <= s.alike) | (F.col("w1") < s.least_rows), "*").when(F.col("kinds") <= s.distinct, F.col("segment")).when(z > 0, "*worse").otherwise("*better")
        steps = branches.join(parents, ["host", "template"]).select("host", "template", "segment", step.alias("step"))
        tree = tree.join(steps, ["host", "template", "segment"]).select("host", "key", "w", "bad", "known", F.array_append("template", F.col("step")).alias("template"))
        tree = scratch.save(tree, f"level-{level + 1}")
    # smoothed shares: all hosts, then the host, then the template
    overall = tree.filter(F.col("host") != ALL).agg(((F.coalesce(F.sum("bad"), F.lit(0.0)) + 0.5) / (F.coalesce(F.sum("w"), F.lit(0.0)) + 5.0)).alias("p0"))
    p0 = float(overall.first()[0])
    smooth = lambda prior: (F.sum("bad") + s.prior_rows * prior) / (F.sum("w") + s.prior_rows)
    hosts = tree.groupBy("host").agg(smooth(F.lit(p0)).alias("p1"))
    shares = tree.groupBy("host", "template").agg(F.sum("bad").alias("b"), F.sum("w").alias("w")).join(hosts, "host")
    shares = shares.select("host", "template", ((F.col("b") + s.prior_rows * F.col("p1")) / (F.col("w") + s.prior_rows)).alias("bad_share"))
    found = tree.select("host", "template", "key").join(shares, ["host", "template"]).select("host", "key", F.array_join(F.filter("template", lambda x: x != ""), "/").alias("template"), "bad_share")
    found = scratch.save(found, "shares")
    known = tree.groupBy("host").agg((F.sum("known") > 0).alias("known"))
    everywhere = found.filter(F.col("host") == ALL).select("key", F.col("template").alias("t_all"), F.col("bad_share").alias("share"))
    seen = own.filter("bad > 0").select("key", site_of(F.col("host")).alias("site")).distinct().join(everywhere, "key").groupBy("t_all").agg(F.count_distinct("site").alias("sites"))
    everywhere = everywhere.join(seen, "t_all", "left").select("key", "t_all", F.when(F.col("sites") >= s.least_sites, F.col("share")).otherwise(0.0).alias("s_all"))
    both = found.filter(F.col("host") != ALL).join(known, "host").join(everywhere, "key")
    return both.select("host", "key", F.when(F.col("known"), F.col("template")).otherwise(F.col("t_all")).alias("template"), F.when(F.col("known"), F.col("bad_share")).otherwise(F.col("s_all")).alias("bad_share"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, settings: Settings = Settings()) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, bad_share`` for every row of ``pages``.

    The verdict is the rule's where one fits, else the tree's: ``block`` where the template's smoothed share of bad reaches
    ``block_at``. A url without a host is allowed unless its template says otherwise. Null urls, null page_ids and repeated
    rows keep a row each; segments of a very long path beyond the tree's depth are one tail; other columns are ignored; an
    empty table gives an empty result.
    """
    url = F.coalesce("url", F.lit(""))
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "verdict": verdict})
    tree = template_tree(rows, settings)
    judged = rows.withColumn("key", segments(F.col("path"), settings.depth)).join(tree, ["host", "key"], "left")
    learned = F.when(F.col("bad_share") >= settings.block_at, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", learned).alias("verdict"), "template", "bad_share")
