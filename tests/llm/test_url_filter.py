import random
import re

from glintsieve.llm.url_filter import filter_urls


def judged(url, rules, default="allow"):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (found[1], found[2]) if found else ("", "")
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(len(h) + len(p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best[3] if best else None, best[2] if best else default


def compare(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "key", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, salt int")
    given = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(pages, given).collect()}
    assert got == {i: judged(u, rules) for i, u in enumerate(urls)}


def test_random_nested_rules(spark):
    draw = random.Random(4)
    labels, parts = ["a", "b", "net", "com", "x-y"], ["", "/", "/a", "/a/", "/ab/c", "/a/b/", "/é"]
    host = lambda: ".".join(draw.choice(labels) for _ in range(draw.randint(1, 4)))
    rules = list({(h, p): (h, p, draw.choice(["allow", "block"])) for h, p in ((host(), draw.choice(parts)) for _ in range(60))}.values())
    urls = [f"http://{host()}{draw.choice(parts)}{draw.choice(parts)}{draw.choice(['', '?q=/a', '#/a'])}" for _ in range(800)]
    compare(spark, urls, rules)


def test_odd_urls(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow")]
    urls = [None, "", "no scheme", "http://", "://net/", "http://NET", "http://NET/", "x://y://net/", "http://examplenet/", "http://a.example.net/en/x?y#z", "http://a.Example.NET/de/", "http://net:80/", "http://u@net/", "http://.net/", "http://net./", "HTTP://İ.net/", "http://net?/", "a\nb://net/\nc", *["http://hot.net/x"] * 50]
    compare(spark, urls, rules)


def test_no_rules_and_no_pages(spark):
    compare(spark, ["http://net/", None], [])
    empty = spark.createDataFrame([], "page_id long, url string")
    assert filter_urls(empty, spark.createDataFrame([("net", "/", "block")], "host string, path string, verdict string")).collect() == []


def test_same_place_blocks_and_nulls_are_left_out(spark):
    rules = spark.createDataFrame([("net", "/", "allow"), ("net", "/", "block"), (None, "/", "block"), ("net", None, "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(None, "http://net/"), (None, "http://net/")], "page_id long, url string")
    assert [tuple(r) for r in filter_urls(pages, rules).collect()] == [(None, "net", "/", "net/", "block")] * 2


def test_the_plan_is_native(spark):
    pages = spark.createDataFrame([(1, "http://net/")], "page_id long, url string")
    rules = spark.createDataFrame([("net", "/", "block")], "host string, path string, verdict string")
    plan = filter_urls(pages, rules)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
