from tidemark.llm import url_rules as ur

PAGES, RULES = "page_id long, url string, host int", "host string, path string, verdict string, tier int"


def judge(spark, urls, rules, **kw):
    pages = spark.createDataFrame([(i, u, 0) for i, u in enumerate(urls)], PAGES)
    out = ur.judge(pages, spark.createDataFrame(rules, RULES), **kw)
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}


def plain(url, rules, default="allow"):
    """The contract's rule by string functions."""
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    words = {"~" + w for w in host.replace("-", ".").split(".")}
    fit = [r for r in rules if host and None not in r and (r[0] in words if r[0][:1] == "~" else (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1]))]
    if not fit:
        return host, path, None, default
    best = max(fit, key=lambda r: (-r[3], len(r[0] + r[1]), len(r[0]), r[2]))
    return host, path, best[0] + best[1], best[2]


def test_matches_string_functions(spark):
    rules = [("com", "/en/", "block", 0), ("example.com", "/en/7", "allow", 0), ("a.example.com", "", "block", 0), ("example.com", "/en/7", "block", 1), ("net", "", "block", 1), ("x.net", "/p", "allow", 1), ("x.net", "/p", "block", 1)]
    urls = [
        "http://Example.COM/en/77", "https://b.example.com/en/8?x=/en/7", "http://badexample.com/en/7", "http://com/en/", "http://a.example.com", "ftp://a.example.com?q#f", "http://x.net/page#top", "http://y.x.net/q",
        "no scheme.com/en/", None, "", "://", "http:///en/", "http://é.com/en/é", "http://h.com/e\nn", "a://b.com/en/://c.net/", "http://example.com/" + "en/" * 3000, "http://example.com/en/7",
    ]
    got = judge(spark, urls, rules)
    assert got == {i: plain(u, rules) for i, u in enumerate(urls)}


def test_repeats_empty_rules_and_empty_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x", 0), (1, "http://a.com/x", 0), (None, "http://a.com/x", 0)], PAGES)
    none = spark.createDataFrame([], RULES)
    assert [(r.rule, r.verdict) for r in ur.judge(pages, none, default="block").collect()] == [(None, "block")] * 3
    assert ur.judge(pages.limit(0), none).count() == 0
    null = spark.createDataFrame([(None, "/", "block", 0), ("com", None, "block", 0)], RULES)
    assert {r.verdict for r in ur.judge(pages, null).collect()} == {"allow"}


def test_hosts_of_many_labels(spark):
    pages = spark.createDataFrame([(1, "http://" + "a." * 20_000 + "example.com/x"), (2, "http://" + "b" * 100_000 + "/x")], "page_id long, url string")
    rules = spark.createDataFrame([("example.com", "/x", "block", 0)], "host string, path string, verdict string, tier int")
    from tidemark.llm import url_rules

    assert {r.page_id: r.verdict for r in url_rules.judge(pages, rules).collect()} == {1: "block", 2: "allow"}


def test_fifty_thousand_rules_with_precedence(spark, monkeypatch):
    """Rules by broadcast and by shuffle, of several tiers, overlapping in host and path."""
    import random

    rnd = random.Random(3)
    hosts = [".".join(rnd.choice("abcdefgh") * rnd.randrange(1, 3) for _ in range(rnd.randrange(1, 4))) + rnd.choice([".com", ".net", ".org"]) for _ in range(400)]
    rules = [(rnd.choice(hosts) if i % 3 else f"h{i}.{rnd.choice(hosts)}", "".join(f"/{rnd.choice('xyz')}" for _ in range(rnd.randrange(4))), rnd.choice(["allow", "block"]), rnd.randrange(3)) for i in range(50_000)]
    rules += [("~pills", "", "block", 1), ("~aa", "", "allow", 0), (None, "/", "block", 0), ("com", None, "block", 0), ("com", "", None, 0)]
    urls = [f"http://{rnd.choice(['', 'www.', 'cheap-pills.', 'h9.'])}{rnd.choice(hosts)}" + "".join(f"/{rnd.choice('xyz')}" for _ in range(rnd.randrange(5))) for _ in range(300)]
    want = {i: plain(u, rules) for i, u in enumerate(urls)}
    assert judge(spark, urls, rules) == want and len({v[3] for v in want.values()}) == 2
    monkeypatch.setattr(ur, "BROADCAST_RULES", 0)
    assert judge(spark, urls, rules) == want


def test_default_rules_block_by_words(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(["http://best-casino.example.org/x", "http://spam-farm.example.org", "http://pills.example.com", "http://spillscasinos2.example.com", "http://example.org/casino"])], "page_id long, url string")
    got = {r.page_id: r.verdict for r in ur.judge(pages, ur.default_rules(spark)).collect()}
    assert got == {0: "block", 1: "block", 2: "block", 3: "allow", 4: "allow"}
