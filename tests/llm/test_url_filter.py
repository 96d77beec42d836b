import re

from trackloom.llm import url_filter as u

SCHEMA = "page_id long, url string, host string, path string, key string, verdict string"


def brute(url):
    at = (url or "").find("://")
    if at < 0:
        return "", "", None, None
    rest = url[at + 3 :]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = host.translate(str.maketrans(u.AZ, u.LOW))
    fits = [r for r in u.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best and best.verdict


def frame(spark, urls):
    return spark.createDataFrame([(k if k else None, x, "h", "p", "k", "v") for k, x in enumerate(urls)], SCHEMA).repartition(3)


EDGE = [None, "", "x", "http://", "http://A.COM", "http://a.com/", "ftp://WWW.Example.com/en/1?x", "://x.net/es/", "http://net/fr/1", "http://anet/es/1", "http://b.net/es", "http://example.com/en/", "http://m.example.com/en/a#b", "http://e.com#/en/", "http://e.org?u=http://x.com/", "http://x.org/\nfr/", "a://b://c/d", "http://h.org/" + "s/" * 30000, "http://ÄÖ.net/ES/1"]


def test_rules(spark):
    urls = EDGE + EDGE[3:9] + [f"http://h{k % 3}.net/{lang}/{k}" for k in range(60) for lang in ("en", "es", "fr")]
    got = u.judge(frame(spark, urls)).collect()
    assert len(got) == len(urls)
    by = {}
    for k, x in enumerate(urls):
        by.setdefault(k if k else None, brute(x))
    for r in got:
        host, path, rule, verdict = by[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_tree_extends_labels(spark):
    """Templates that the rules block almost always pull their unlabelled look-alikes; clean ones stay."""
    rules = (u.Rule("bad.org", "/deals/buy1", "block"), u.Rule("bad.org", "/news/", "allow"))
    urls = [f"http://bad.org/deals/buy{k}/x" for k in range(100, 200)] + [f"http://bad.org/deals/buy9{k}/x" for k in range(5)] + [f"http://bad.org/news/n{k}" for k in range(100)] + ["http://bad.org/about"] * 10
    got = {r.page_id: r for r in u.judge(frame(spark, urls), rules).collect()}
    assert {got[k].verdict for k in range(100, 105)} == {"block"}
    assert {got[k].verdict for k in range(106, 215)} == {"allow"}


def test_hosts_without_rules_take_the_shares_of_all_hosts(spark):
    rules = (u.Rule("a.org", "/casino/", "block"), u.Rule("b.org", "/casino/", "block"), u.Rule("a.org", "/docs/", "allow"))
    urls = [f"http://{h}.org/casino/{k}" for h in "ab" for k in range(60)] + [f"http://a.org/docs/{k}" for k in range(60)]
    urls += [f"http://new.org/{part}/{k}" for part in ("casino", "docs") for k in range(5)]
    got = {r.page_id: r for r in u.judge(frame(spark, urls), rules).collect()}
    assert {got[k].verdict for k in range(180, 185)} == {"block"} and {got[k].verdict for k in range(185, 190)} == {"allow"}
    assert got[180].rule is None and got[180].template.startswith("casino")


def test_one_site_alone_says_nothing_of_others(spark):
    """The same pages, bad on hosts of one site only, and with that site left out of three."""
    def verdicts(rules):
        urls = [f"http://{h}/casino/{k}" for h in ("a.org", "m.a.org", "b.org", "c.net") for k in range(40)] + [f"http://{h}/docs/{k}" for h in ("a.org", "b.org", "c.net") for k in range(60)]
        got = u.judge(frame(spark, urls), rules).collect()
        return {(h, part): {r.verdict for r in got if r.host == h and r.path.startswith(f"/{part}")} for h in ("a.org", "m.a.org", "b.org", "c.net") for part in ("casino", "docs")}

    bad, good = lambda h: u.Rule(h, "/casino/", "block"), lambda h: u.Rule(h, "/docs/", "allow")
    one = verdicts((bad("a.org"), good("a.org")))
    assert one["m.a.org", "casino"] == {"block"} and one["b.org", "casino"] == one["c.net", "casino"] == {"allow"}
    for left in ("a.org", "b.org", "c.net"):  # each site judged from the other two
        rules = tuple(f(h) for h in ("a.org", "b.org", "c.net") if h != left for f in (bad, good))
        found = verdicts(rules)
        assert found[left, "casino"] == {"block"} and found[left, "docs"] <= {"allow"}


def test_empty(spark):
    assert u.judge(frame(spark, [])).collect() == []
