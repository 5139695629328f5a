import random

import duckdb

from docstruct.llm import urlrules as u
from docstruct.llm.registry import op8_urlrules
from tests.conftest import MEDIUM

PAGE = "page_id long, url string"


def plain(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?", 1)[0].split("#", 1)[0]
    fits = [(len(h) + len(p), len(h), p, h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, best and best[3], best[4] if best else default)


def judged(spark, urls, rules, **options):
    pages = spark.createDataFrame([(i, x, "h") for i, x in enumerate(urls)], PAGE + ", host string")
    out = u.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), **options)
    return [tuple(r)[1:] for r in sorted(out.collect())]


ODD = [None, "", "no scheme", "http://", "http:///x", "HTTP://WWW.Example.COM/en/a?b#c", "http://example.com/en/", "http://notexample.com/en/", "http://a.b.example.com/en/x", "http://example.com", "http://example.com?/en/", "http://x.net/es/#", "ftp://net/fr/", "a://b://example.com/en/", "http://example.com./en/", "http://ÉX.com/\n/x", "http://.com/", "http://com/"]


def test_stated_rules(spark):
    assert judged(spark, ODD, list(u.RULES)) == [plain(x, u.RULES) for x in ODD]


def test_random_rules(spark):
    rng = random.Random(5)
    labels = ["a", "b", "ab", "c-d", "com"]
    host = lambda n: ".".join(rng.choice(labels) for _ in range(n))
    path = lambda: "/" + "/".join(rng.choice(["x", "xy", "z"]) for _ in range(rng.randint(0, 3)))
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((host(rng.randint(1, 4)), path()) for _ in range(300))}.values())
    urls = [f"http://{host(rng.randint(1, 5))}{path()}{rng.choice(['', '?q', '#f', '/'])}" for _ in range(1500)]
    assert judged(spark, urls, rules, task_hosts=40) == [plain(x, rules) for x in urls]


def test_cases(spark):
    assert judged(spark, ["http://a.com/"] * 2, [], default="block") == [("a.com", "/", None, "block")] * 2
    assert judged(spark, ["http://a.com/"], [("a.com", "/", "allow"), ("a.com", "/", "block"), ("", "/", "block"), (None, "/", "block"), ("a.com", None, "block")]) == [("a.com", "/", "a.com/", "block")]
    assert judged(spark, [], list(u.RULES)) == []


def test_sql_and_plan(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{MEDIUM}/pages.parquet'")
    out = op8_urlrules(spark, MEDIUM)
    assert sorted(con.sql(u.JUDGE_SQL).fetchall()) == sorted(tuple(r) for r in out.collect())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop")) and "html" not in plan


def test_very_long_url(spark):
    urls = ["http://example.com/en/" + "x" * 200_000, "http://" + "a." * 300 + "com/", "http://" + "y" * 100_000]
    assert judged(spark, urls, list(u.RULES)) == [plain(x, u.RULES) for x in urls]


def test_many_rules_of_one_host(spark):
    rules = [("com", f"/{k}/", "block" if k % 2 else "allow") for k in range(2000)] + [("com", "", "block")]
    urls = [f"http://h{k % 50}.com/{k}/x" for k in range(0, 4000, 7)]
    assert judged(spark, urls, rules, task_hosts=10) == [plain(x, rules) for x in urls]
