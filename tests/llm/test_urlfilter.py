import random

from pyspark.sql import functions as F

from casetally.llm import urlfilter as U
from casetally.llm.queries import URL_RULES


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), path


def brute(url, rules):
    host, path = split(url)
    fits = []
    for rule, action in rules:
        if rule:
            h, q = split("x://" + rule)[0], rule[rule.index("/"):] if "/" in rule else ""
            if h and host and (host == h or host.endswith("." + h)) and path.startswith(q):
                fits.append((-len(h + q), action != "block", h + q))
    if not fits:
        return host, path, None, "allow"
    best = min(fits)
    return host, path, best[2], "allow" if best[1] else "block"


def urls():
    rng = random.Random(3)
    hosts = ["example.net", "a.example.net", "EXAMPLE.com", "b.c.example.com", "x.org", "org", "net", "notexample.net", "a..b.net", "ünï.org", "h:80.net"]
    paths = ["", "/", "/en/", "/en", "/en/x/y", "/de/1", "/fr/q", "/enx", "//en/", "/a/b/c/d/e/f", "/en/" + "z" * 3000]
    made = [f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?a=/b://c', '#f/', '?'])}" for _ in range(300)]
    return made + [None, "", "no scheme/net/", "://", "http:///en/", "http://net", "a://b://net/", "http://x.net/a\nb", "http://x.net/é"]


def check(spark, rules):
    rows = [(i, u, "old", 7) for i, u in enumerate(urls())] + [(None, "http://a.net/", "old", 7), (0, urls()[0], "old", 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, block int")
    listed = spark.createDataFrame(rules, "rule string, action string")
    found = U.filter_urls(pages, listed)
    assert found.columns == ["page_id", "url", "block", "host", "path", "rule", "verdict"]
    got = sorted(((r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in found.collect()), key=str)
    assert got == sorted(((i, u, *brute(u, rules)) for i, u, *_ in rows), key=str)


def test_contract_rules(spark):
    check(spark, URL_RULES)


def test_odd_and_many_rules(spark, monkeypatch):
    odd = [("Example.NET/en", "block"), ("example.net", "allow"), (None, "block"), ("", "block"), ("/x", "block"), ("org/fr/", "allow"), ("org/fr/", "block"),
           ("b.net/", "allow"), ("c.example.com/de/1", "allow"), ("net", "block")]
    check(spark, odd)
    monkeypatch.setattr(U, "MAX_BLOCKS", 4)
    many = [(f"h{i}.example.com/p{i}/", "block" if i % 2 else "allow") for i in range(2000)]
    check(spark, odd + many)


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    none = spark.createDataFrame([], "rule string, action string")
    listed = spark.createDataFrame(URL_RULES, "rule string, action string")
    assert [(r.rule, r.verdict) for r in U.filter_urls(pages, none).collect()] == [(None, "allow")]
    assert U.filter_urls(pages.limit(0), listed).count() == 0


def test_bloom_filter_has_no_false_negative_and_few_false_hits(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    others = spark.range(3000, 13000).select(F.concat(F.lit("k"), "id").alias("key"))
    blocks = -(-3000 * U.BITS_PER_KEY // 512)
    bloom = U.bloom_filter(keys, "key", blocks)
    assert U.possible_hits(keys, "key", bloom, blocks).count() == 3000
    assert U.possible_hits(others, "key", bloom, blocks).count() < 100
