"""Mining against all token sets of the labelled URLs, however long the URLs are."""

import random
from itertools import combinations

from tracelake.llm import url_filter


def test_tokens_past_the_fourteenth_are_mined(spark):
    slug = "-".join(f"w{chr(97 + i)}" for i in range(18))
    rows = [(f"http://a.example/{slug}?{('bad', 'good')[i % 2]}", i % 2 == 0) for i in range(80)]
    rules = url_filter.mine(spark.createDataFrame(rows, "url string, blocked boolean"))
    assert [(list(r.tokens), r.key, r.confidence, r.support, r.lift) for r in rules.collect()] == [(["q:bad"], "q:bad", 1.0, 0.5, 2.0)]
    pages = spark.createDataFrame([(1, "http://b.example/x?bad"), (2, "http://b.example/x?good"), (3, f"http://a.example/{slug}?other")], "page_id long, url string")
    assert sorted((r.page_id, r.verdict) for r in url_filter.judge(pages, rules).collect()) == [(1, "block"), (2, "allow"), (3, "allow")]


def test_verdicts_are_those_of_all_frequent_sets(spark):
    rng = random.Random(7)
    words = "abcdefgh"
    rows = []
    for _ in range(260):
        mine = {w for w in words if rng.random() < 0.5}
        mine |= {"x", "y"} if "a" in mine else set()
        rows.append((mine, rng.random() < (0.95 if {"a", "b", "c"} <= mine else 0.75 if {"d", "e"} <= mine else 0.3)))
    url = lambda s: "http://h/" + "/".join(sorted(s))
    need, base = 20, sum(b for _, b in rows) / len(rows)
    best = {}
    for k in range(1, 11):
        for c in combinations(words + "xy", k):
            of = [b for s, b in rows if s >= set(c)]
            if sum(of) >= need and sum(of) / len(of) >= 0.6 and sum(of) / len(of) > base:
                best[frozenset(c)] = sum(of) / len(of)
    assert any(len(c) > 2 for c in best)
    rules = url_filter.mine(spark.createDataFrame([(url(s), b) for s, b in rows], "url string, blocked boolean"))
    pages = [(i, url(s), max((v for c, v in best.items() if c <= s), default=None)) for i, s in enumerate([set(rng.sample(words + "xy", rng.randrange(1, 10))) for _ in range(80)])]
    got = url_filter.judge(spark.createDataFrame([p[:2] for p in pages], "page_id long, url string"), rules, fixed=())
    assert {r.page_id: (r.verdict, r.confidence) for r in got.collect()} == {i: ("allow" if v is None else "block", v) for i, _, v in pages}
