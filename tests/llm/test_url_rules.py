from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tickloom.llm import url_rules

RULES = "host string, path string, verdict string"
URLS = "page_id long, url string"
ODD = [
    "https://Example.ORG/es/1", "http://a.b.example.org/en/12?x=/de/", "http://example.org", "http://example.org?/es/", "http://example.org#/", "x://org/",
    "http://badexample.org/es/", "http://user@shop.com:80/fr/", "http://shop.com/fr/", "http://com/de/", "http://.com/de/", "http://com./de/", "//com/de/", "", None,
    "http://", "a://b://com/de/", "http://ÄÖ.com/dé/", "http:///es/", "HTTP://x.com/DE/", "http://x.com/de", "http://" + "a." * 5000 + "com/de/" + "y" * 20000,
]


def plain(url, rules, default="allow"):
    """Rule by rule, on text."""
    _, found, rest = (url or "").partition("://")
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, after = rest[:cut], rest[cut:]
    path = after[: min([after.find(c) for c in "?#" if c in after], default=len(after))]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = max(
        ((len((h + p).encode()), len(h.encode()), h + p, v) for (h, p), v in rules.items() if (host == h or (h and host.endswith("." + h))) and path.startswith(p)),
        default=None,
    ) if found else max(((len(p), 0, p, v) for (h, p), v in rules.items() if h == "" and p == ""), default=None)
    return (host, path, best[2], best[3]) if best else (host if found else "", path if found else "", None, default)


def drawn(seed):
    rng = random.Random(seed)
    names, parts = ["a", "b.a", "c.b.a", "a.a", "org", "xorg", "b.org", ""], ["", "/", "/e", "/es/", "/es/1", "/es/12"]
    rules = {(rng.choice(names), rng.choice(parts)): rng.choice(url_rules.VERDICTS) for _ in range(20)}
    urls = [f"{rng.choice(['http://', 'x://', ''])}{rng.choice(['', 'q.', 'b.', 'Z.'])}{rng.choice(names)}{rng.choice(parts)}{rng.choice(['', '2', '?a=/es/', '#t'])}" for _ in range(400)]
    return rules, urls


@pytest.mark.parametrize("mask, most", [(-1, 1000), (3, 1000), (0, 1000), (3, 5)])
def test_verdicts_equal_brute_force_with_and_without_collisions(spark, mask, most):
    """With few bits of digest left nearly all probes collide; with few rules allowed they meet in a join."""
    rules, urls = drawn(4)
    urls = [*urls, *ODD]
    frame = spark.createDataFrame(list(enumerate(urls)), URLS).selectExpr("*", "'x' as host", "'y' as rule", "1 as key")
    table = spark.createDataFrame([(h, p, v) for (h, p), v in rules.items()], RULES).withColumn("digest", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judged_urls(frame, table, mask=mask, max_rules=most).collect()}
    assert got == {i: plain(url, rules) for i, url in enumerate(urls)}


def test_odd_rules_and_rows(spark):
    rows = [(1, "http://a.org/x"), (1, "http://a.org/x"), (None, "http://a.org/x"), (2, None), (3, "http:///x")]
    frame = spark.createDataFrame(rows, URLS)
    rules = [("ORG", "/", "allow"), ("org", "/", "block"), ("org", "/", "block"), ("a.org", "/x", None), ("a.org", "/x", "maybe"), (None, "/", "block")]
    got = sorted((tuple(r) for r in url_rules.judged_urls(frame, spark.createDataFrame(rules, RULES)).collect()), key=str)
    assert got == sorted([(1, "a.org", "/x", "org/", "block")] * 2 + [(None, "a.org", "/x", "org/", "block"), (2, "", "", None, "allow"), (3, "", "/x", "/", "block")], key=str)
    none = spark.createDataFrame([], RULES)
    assert {r.verdict for r in url_rules.judged_urls(frame, none, default="block").collect()} == {"block"}
    assert url_rules.judged_urls(frame.limit(0), none).count() == 0
    assert "Exchange" not in url_rules.judged_urls(frame, none)._jdf.queryExecution().executedPlan().toString()


def test_digests_are_those_of_spark(spark):
    texts = ["", "a", "org\0/", "é" * 40]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("d")).collect()
    assert all(url_rules.digest(r.t.encode()) == r.d for r in rows)
