import random

from loomsearch.llm import queries, url_filter


def key_of(spark, urls, f):
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    return [r[0] for r in df.select(f(df["u"])).collect()]


def test_keys(spark):
    urls = ["https://www.Shop.example.com:443/a?b#c", "http://u:p@ex.org", "ex.org?q", "//x", None, "", "HTTP://A.B./x"]
    assert key_of(spark, urls, url_filter.url_key)[:3] == ["com,example,shop,)/a?b", "org,ex,)/", "org,ex,)/?q"]
    assert key_of(spark, urls, url_filter.url_key)[4] is None and key_of(spark, urls, url_filter.url_key)[6] == "b,a,)/x"
    assert key_of(spark, ["example.com", "shop.example.com/a"], url_filter.rule_prefix) == ["com,example,", "com,example,shop,)/a"]


def test_equals_brute_force(spark):
    r = random.Random(2)
    hosts = ["a.ex.com", "ex.com", "b.a.ex.com", "notex.com", "x.org", "y.x.org"]
    pages = [(i, f"http://{r.choice(hosts)}/{r.choice(['', 'p', 'p/q', 'pq', 'é'])}", "k") for i in range(200)] + [(None, None, "k"), (7, "", "k"), (7, "http://ex.com/p", "k")]
    rules = [(i, r.choice([*hosts, "com", "ex.com/p", "a.ex.com/p/", "x.org/"]), r.choice(["block", "allow"])) for i in range(25)] + [(None, "com", "block"), (90, None, "block"), (91, " ", "block"), (3, "ex.com", "block"), (92, "y.x.org/p/q", None)]
    p = spark.createDataFrame(pages, "page_id bigint, url string, pid string")
    q = spark.createDataFrame(rules, "rule_id bigint, pattern string, action string")
    prefixes = [(i, k, a) for (i, pat, a), k in zip(rules, key_of(spark, [x[1] for x in rules], url_filter.rule_prefix)) if i is not None and pat and pat.strip()]
    expected = []
    for (i, _, _), k in zip(pages, key_of(spark, [x[1] for x in pages], url_filter.url_key)):
        hit = [x for x in prefixes if k is not None and k.startswith(x[1])]
        best = min(hit, key=lambda x: (-len(x[1]), x[0], x[2] or ""), default=(None, None, "allow"))
        expected.append((i, k, best[0], best[2] or "allow", len(hit)))
    for parts in (1, 5):
        got = [tuple(x) for x in url_filter.filter_urls(p, q, partitions=parts).collect()]
        assert sorted(map(str, got)) == sorted(map(str, expected))


def test_empty(spark):
    p = spark.createDataFrame([], "page_id bigint, url string")
    assert url_filter.filter_urls(p, url_filter.listed_rules(spark)).count() == 0
    one = spark.createDataFrame([(1, "http://a.b/")], "page_id bigint, url string")
    assert url_filter.filter_urls(one, url_filter.listed_rules(spark).limit(0)).collect()[0]["action"] == "allow"


def test_lists_block_unwanted_pages_only(spark, tmp_path):
    unwanted = ["http://m.casino-win.example.com/en/4", "https://free-bets.example.net/x", "http://www.cheap-pills.example.org/", "http://blog.adult-x.example.com/", "https://ads-track.example.com/a?b", "http://spam-farm.example.org/en/1", "https://de.pornhub.com/v", "http://a.casino/", "https://www.reddit.com/r/nsfw/top", "https://www.facebook.com/tr?id=1"]
    wanted = ["http://ththre.example.com/fr/8", "https://www.example.org/", "http://tionsh.example.net/fr/2", "https://www.reddit.com/r/python/", "https://casino-winner.example.com/", "https://notpornhub.com/", "https://www.facebook.com/trees", None]
    pages = [(i, u) for i, u in enumerate(unwanted + wanted)]
    spark.createDataFrame(pages, "page_id bigint, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["action"] for r in queries.QUERIES["op9_url_filter"](spark, str(tmp_path)).collect()}
    assert got == {i: "block" if i < len(unwanted) else "allow" for i, _ in pages}


def test_lists_hold_each_pattern_once(spark):
    rules = url_filter.listed_rules(spark).collect()
    assert len({r["pattern"] for r in rules}) == len({r["rule_id"] for r in rules}) == len(rules)
    assert {r["action"] for r in rules} == {"block"} and all(r["category"] for r in rules)
