import random

import pytest

from textlab.llm import urls
from textlab.llm.queries import URL_RULES

RULES = "host string, path string, verdict string"


def slow(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    best = (None, "allow")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]))):
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = (h + p, v)
    return host, path, *best


def random_url(rng):
    host = ".".join(rng.choices(["www", "a", "b", "example", "com", "net", "ÉX", "Com"], k=rng.randint(1, 5)))
    path = "".join(rng.choices(["/", "en", "es/", "x", "é", "//"], k=rng.randint(0, 5)))
    return rng.choice(["http://", "ftp://", "://", ""]) + host + path + rng.choice(["", "?a=/b", "#x?y", "://z"])


@pytest.mark.parametrize("blocks", [1, urls.MAX_BLOCKS])
def test_by_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(urls, "MAX_BLOCKS", blocks)
    rng = random.Random(blocks)
    rules = [*URL_RULES, ("b.example.net", "/en", "allow"), ("a.b", "", "block"), ("éx", "//", "block")]
    rules += [(f"h{i}.com", "/", "block") for i in range(300)]  # fills a small filter
    rows = [(i, random_url(rng)) for i in range(400)]
    rows += [(1000, None), (1001, ""), (None, "http://Example.com/en/"), (5, "http://h7.com/"),
             (6, "http://x.h8.COM/q"), (6, "http://x.h8.COM/q"), (7, "http://" + "a." * 3000 + "com/"),
             (8, "http://com/" + "x" * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'k' AS host", "'z' AS rule")
    got = urls.judge_urls(df, spark.createDataFrame(rules, RULES))
    out = got.collect()
    assert len(out) == len(rows)
    want = sorted(((i, u, *slow(u, rules)) for i, u in rows), key=repr)
    assert sorted(((r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in out), key=repr) == want


def test_odd_rules(spark):
    df = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    none = urls.judge_urls(df, spark.createDataFrame([], RULES)).collect()
    assert [(r.rule, r.verdict) for r in none] == [(None, "allow")]
    odd = [(None, "/", "block"), ("", "/", "block"), ("A.com", None, "block"), ("a.com", "", "allow")]
    got = urls.judge_urls(df, spark.createDataFrame(odd, RULES)).collect()
    assert [(r.rule, r.verdict) for r in got] == [("a.com", "block")]
    assert urls.judge_urls(df.limit(0), spark.createDataFrame(odd, RULES)).count() == 0
