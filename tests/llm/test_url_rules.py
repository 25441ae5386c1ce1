import random

from termweave.llm import queries, url_rules

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.example.net", "/en/x", "block"), ("b-example.net", "/", "allow")]
URLS = [
    "http://a.example.net/en/x/y", "https://EXAMPLE.net/en/", "https://b-example.net/en/1", "http://net/", "http://net", "http://xnet/", "http://u:p@h.net:80/?q=http://x", "http://example.com/de/#f",
    "http://x.example.com?de/", "https://a.b.org/fr/1?x", "https://org.example/fr/", "no scheme", "", None, "://", "http:///net/", "http://www.example.net.org/fr/", "http://example.net/de/", "HTTP://A.EXAMPLE.NET/EN/X",
]


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut], rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), len(h), a, h + p) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def rows(df):
    return sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in df.collect()), key=repr)


def test_against_brute_force(spark):
    draw = random.Random(1)
    labels, paths = ["a", "b", "example", "net", "org", "com", "b-example"], ["", "/", "/en/", "/en/x", "/fr/1", "/de/2?q", "/e#/en/"]
    urls = URLS + ["http://" + ".".join(draw.choices(labels, k=draw.randint(1, 4))) + draw.choice(paths) for _ in range(400)]
    rules = RULES + [(".".join(draw.choices(labels, k=draw.randint(1, 3))), draw.choice(paths[1:5]), draw.choice(["allow", "block"])) for _ in range(30)]
    pages = spark.createDataFrame([(i // 2, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = rows(url_rules.judge(pages, spark.createDataFrame(rules, "host string, path string, action string")))
    want = sorted(((i // 2, *brute(u, rules)) for i, u in enumerate(urls)), key=repr)
    assert got == want
    for ranges in (1, 3, 60):
        assert rows(url_rules.judge(pages, spark.createDataFrame(rules, "host string, path string, action string"), ranges=ranges)) == want


def test_a_hot_host_and_a_repeated_row_spread_over_ranges(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    urls = ["http://a.example.net/en/x"] * 400 + [None] * 400 + ["http://zz.net/"] * 3
    pages = spark.createDataFrame([(None, u) for u in urls], "page_id long, url string").repartition(4)
    found = url_rules.judge(pages, rules, ranges=16)
    assert rows(found) == sorted(((None, *brute(u, RULES)) for u in urls), key=repr)
    written = spark.read.parquet(found.inputFiles()[0].rsplit("/", 1)[0])
    assert max(r["count"] for r in written.where("is_url = 1").groupBy("part").count().collect()) < len(urls) / 4
    assert written.where("is_url = 0").count() == 2 * len(RULES)  # no copy of the rules for each range



def test_nulls_repeats_and_empty_tables(spark):
    rules = spark.createDataFrame(RULES + [(None, "/", "block"), ("x", None, "block")], "host string, path string, action string")
    pages = spark.createDataFrame([(None, "http://a.net/"), (None, "http://a.net/"), (7, None)], "page_id long, url string")
    got = rows(url_rules.judge(pages, rules))
    assert got == sorted([(None, "a.net", "/", "net/", "block")] * 2 + [(7, "", "", None, "allow")], key=repr)
    assert rows(url_rules.judge(pages, rules.where("false"), default="block"))[0][4] == "block"
    assert rows(url_rules.judge(pages.where("false"), rules)) == []


def test_plan_is_native(spark, data):
    plan = queries.op1_url_filter(spark, data)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "Arrow" not in plan
