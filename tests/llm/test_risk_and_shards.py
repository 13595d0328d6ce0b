"""The non-negative risk and its gradient against a plain version; shards against plain ranking and cutting; mined rules against counting."""

import hashlib
import math
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import sharding, toxicity, url_filter


@pytest.mark.parametrize("shift", [3.0, -3.0])
def test_risk_and_gradient(shift):
    rng = np.random.default_rng(0)
    fp, fu, prior = rng.normal(size=7) - shift, rng.normal(size=11) + shift, 0.4
    loss = lambda z: math.log1p(math.exp(-z))

    def corrected(p, u):
        return sum(loss(-z) for z in u) / len(u) - prior * sum(loss(-z) for z in p) / len(p)

    def descended(p, u):
        if corrected(p, u) >= 0:
            return prior * sum(loss(z) for z in p) / len(p) + corrected(p, u)
        return -corrected(p, u)

    value, gp, gu = toxicity.risk(fp, fu, prior)
    assert value == pytest.approx(corrected(fp, fu)) and (value >= 0) == (shift > 0)
    h = 1e-6
    for x, g, of in ((fp, gp, lambda z: descended(z, fu)), (fu, gu, lambda z: descended(fp, z))):
        for i in range(len(x)):
            up, down = x.copy(), x.copy()
            up[i] += h
            down[i] -= h
            assert g[i] == pytest.approx((of(up) - of(down)) / (2 * h), abs=1e-5)


def test_shards_are_the_plain_ranking_cut(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_PART", 50)
    rng = np.random.default_rng(1)
    rows = [(int(i), None if i % 41 == 0 else "é" * int(rng.integers(0, 9)), [None, "hot", "hot", "hot", f"s{i % 7}"][i % 5]) for i in range(700)]
    rows += rows[:5]
    order = lambda r: hashlib.md5(f"7:{r[0]}".encode()).hexdigest()
    key = lambda r: (order(r), r[0], zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 1)
    placed = []
    for name in {r[2] for r in rows}:
        mine = sorted((r for r in rows if r[2] == name), key=key)
        placed += [((2 * (i + 1) - 1) / (2 * len(mine)), name or "\0null", key(r), r) for i, r in enumerate(mine)]
    placed.sort(key=lambda x: x[:3])
    want, slots = [], {}
    for i, x in enumerate(placed):
        shard = i * 16 // len(placed)
        want.append((x[3][0], shard, slots.setdefault(shard, 0)))
        slots[shard] += 1
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for parts in (1, 7):  # how the input is dealt changes nothing
        assert sorted((r.doc_id, r.shard, r.slot) for r in sharding.stratified_shards(df.repartition(parts)).collect()) == sorted(want)


def test_verdicts_are_those_of_all_rules_by_counting(spark):
    """Every frequent, confident set of tokens of any length, counted plainly, against what was mined and judged."""
    rng = np.random.default_rng(2)
    words = ["alpha", "beta", "gamma", "delta"]
    rows = []
    for i in range(500):
        picked = [w for w in words if rng.random() < 0.5]
        rows.append((i, f"http://h{'xyz'[i % 3]}.org.uk/" + "/".join(picked) + ("?q=long" if i % 4 else ""), bool(rng.random() < (0.9 if {"alpha", "beta"} <= set(picked) else 0.25))))
    rows += rows[:3]
    df = spark.createDataFrame(rows, "page_id long, url string, blocked boolean")
    tokens = [(frozenset(r.t), r.blocked) for r in df.select(url_filter.tokens_of(F.col("url")).alias("t"), "blocked").collect()]
    n, base, need = len(rows), sum(b for _, b in tokens), max(math.ceil(url_filter.MIN_SUPPORT * len(rows)), url_filter.LEAST_ROWS)
    count = {}
    for t, b in tokens:
        for size in range(1, len(t) + 1):
            for c in combinations(sorted(t), size):
                m = count.setdefault(c, [0, 0])
                m[0] += 1
                m[1] += b
    good = {c: b / m for c, (m, b) in count.items() if b >= need and b / m >= url_filter.MIN_CONFIDENCE and b * n > m * base}
    rules = url_filter.mine(df)
    for r in rules.collect():
        c = tuple(sorted(r.tokens))
        assert good[c] == pytest.approx(r.confidence) and r.support == pytest.approx(count[c][1] / n) and r.lift == pytest.approx(r.confidence / (base / n))
    assert any({"p:alpha", "p:beta"} <= set(r.tokens) for r in rules.collect())
    got = {r.page_id: r for r in url_filter.judge(df, rules, fixed=()).collect()}
    for (page, _, _), (t, _) in zip(rows, tokens, strict=True):
        best = max((v for c, v in good.items() if t >= set(c)), default=None)
        assert (got[page].verdict == "block") == (best is not None) and got[page].confidence == (best and pytest.approx(best))
