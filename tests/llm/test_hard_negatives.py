"""Hard negatives against the plain search over all pairs."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelake.llm import hard_negatives as hn


def plain(rows, anchor, positives=5, negatives=3):
    """rows: (id, vector, label)."""
    good = {(i, lab, tuple(math.floor(256 * x) for x in v)) for i, v, lab in rows if None not in (i, v, lab) and all(x is not None and math.isfinite(x) for x in v)}
    good = {r for r in good if sum(x * x for x in r[2]) < 1 << 54}
    out = []
    for a in (r for r in good if anchor(r[0])):
        score = lambda r, a=a: sum(x * y for x, y in zip(a[2], r[2], strict=True))
        others = [r for r in good if r != a and len(r[2]) == len(a[2])]
        first = lambda rs, k, score=score: sorted(rs, key=lambda r: (-score(r), r[0]))[:k]
        for p in first([r for r in others if r[1] == a[1]], positives):
            band = [r for r in others if r[1] != a[1] and 50 * score(p) <= 100 * score(r) <= 95 * score(p)]
            out += [(a[0], p[0], k, n[0], score(p), score(n)) for k, n in enumerate(first(band, negatives), 1)]
    return sorted(out)


def mined(spark, rows, anchor):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, dim string, row int").repartition(3)
    return sorted(map(tuple, hn.hard_negatives(df, anchor).collect()))


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(hn, "ROWS", 40)
    monkeypatch.setattr(hn, "ANCHORS", 7)
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.3) + (i % 3) for _ in range(6)], i % 4) for i in range(150)]
    rows += [(200 + i, [1.0] * 6, i % 2) for i in range(30)]  # ties
    rows += [(240, rows[0][1], 0), (240, rows[0][1], 0), (241, rows[0][1], 1)]  # repeated rows
    rows += [(300, [1.0, 2.0], 0), (301, [1.0, 2.5], 0), (302, [0.9, 1.0], 1), (310, [5.0], 1)]  # other lengths
    rows += [(320, None, 1), (330, [1.0] * 6, None), (340, [None] * 6, 1), (350, [float("nan")] * 6, 1), (360, [float("inf")] * 6, 1), (370, [1e300] * 6, 1), (None, [1.0] * 6, 1), (380, [0.0] * 6, 1), (390, [-1.0] * 6, 2), (395, [1e5] * 6, 1), (400, [], 1), (401, [], 2), (402, [], 1)]
    want = plain(rows, lambda i: i % 10 == 0)
    assert len(want) > 100 and mined(spark, rows, lambda i: i % 10 == 0) == want


def test_empty_and_one_sided(spark):
    assert mined(spark, [], lambda i: i % 2 == 0) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)], lambda i: i % 2 == 0) == []
    assert mined(spark, [(1, [1.0], 1), (3, [1.0], 2)], lambda i: i % 2 == 0) == []


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 60), st.integers(1, 8), st.sampled_from([2, 40, 3000, 1 << 24]), st.integers(0, 2**32))
def test_intervals_hold_the_scores(n, d, top, seed):
    """At every plane each pair's interval holds its score, and at the last it is the score."""
    rng = np.random.default_rng(seed)
    a, q = rng.integers(-top, top, (5, d)), rng.integers(-top, top, (n, d))
    score, last = a @ q.T, []

    def keep(alive, low, high):
        assert (low <= score).all() and (score <= high).all()
        last[:] = [low, high]
        return alive

    i, j, s = hn.Planes(q).narrow(a, np.ones((5, n), bool), keep)
    assert (last[0] == score).all() and (last[1] == score).all() and (s == score[i, j]).all() and len(s) == 5 * n


@pytest.mark.parametrize("k", [1, 3])
def test_rows_are_dropped_before_the_last_plane(k):
    rng = np.random.default_rng(1)
    q = np.floor(rng.normal(0, 32, (2000, 64))).astype(np.int64)
    seen = []

    def keep(alive, low, high):
        seen.append(alive.shape[1])
        return high >= hn._kth(np.where(alive, low, -hn._FAR), k)

    i, j, s = hn.Planes(q).narrow(q[:4], np.ones((4, 2000), bool), keep)
    assert seen[0] == 2000 and seen[-1] < 200
    assert all(set(np.sort(q[:4] @ q.T, axis=1)[a, -k:]) <= set(s[i == a]) for a in range(4))
