"""Ball-tree k-means against plain integer k-means."""

import hashlib
import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelake.llm import ball_tree as bt


def plain(rows, dim, k, rounds):
    kept = [(i, tuple(math.floor(64 * x) for x in v)) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) and abs(x) <= bt.MOST / 64 for x in v)]
    name = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [q for _, q in sorted(kept, key=name)[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        of = [[] for _ in centroids]
        for _, q in kept:
            of[near(q)[1]].append(q)
        centroids = [tuple(sum(x) // len(m) for x in zip(*m, strict=True)) if m else c for m, c in zip(of, centroids, strict=True)]
    got = [(i, *near(q)[::-1]) for i, q in kept]
    inertia = [sum(d for _, j, d in got if j == c) for c in range(len(centroids))]
    return sorted([(i, j, d, inertia[j], sum(inertia), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, j, d in got], key=repr)


def clustered(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "vec_id long, embedding array<double>, cluster int, q string").repartition(3)
    return sorted(map(tuple, bt.cluster(df, **more).collect()), key=repr)


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(bt, "BLOCK", 50)
    rng = random.Random(2)
    rows = [(i, [rng.gauss(i % 5, 0.2) for _ in range(4)]) for i in range(300)]
    rows += [(400 + i, [2.0, 2.0, 2.0, 2.0]) for i in range(120)] + [(7, rows[7][1]), (7, rows[8][1]), (None, [1.0, 0.0, 0.0, 0.0]), (None, [9.0, 0.0, 0.0, 0.0])]
    rows += [(600, None), (601, [1.0]), (602, []), (603, [None] * 4), (604, [float("nan")] * 4), (605, [float("inf"), 0.0, 0.0, 0.0]), (606, [1e300] * 4), (607, [-1e4, 3.0, 1e4, 0.0])]
    want = plain(rows, 4, 16, 3)
    assert len({r[1] for r in want}) > 4 and clustered(spark, rows, dim=4) == want


def test_few_rows(spark):
    assert clustered(spark, [], dim=2) == []
    for n in (1, 3):
        rows = [(i, [0.5 * i, 1.0]) for i in range(n)]
        assert clustered(spark, rows, dim=2, k=5) == plain(rows, 2, 5, 3)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300), st.integers(1, 5), st.integers(1, 9), st.sampled_from([2, 50, 1 << 27]), st.integers(0, 2**32))
def test_walks_give_the_nearest(n, d, k, top, seed):
    rng = np.random.default_rng(seed)
    q, c = rng.integers(-top, top + 1, (n, d)), rng.integers(-top, top + 1, (k, d))
    balls, order = bt.Balls.build(q)
    balls = bt.Balls.read(balls.columns(), d)
    assert (balls.rows == q[order]).all() and sorted(order) == list(range(n))
    want = ((q[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (balls.assigned(c) == want[order]).all()
    count, total = balls.sums(c)
    assert (count == np.bincount(want, minlength=k)).all() and all((total[j] == q[want == j].sum(axis=0)).all() for j in range(k))


def test_whole_balls_are_assigned():
    """Far clusters: hardly any row is compared by itself."""
    rng = np.random.default_rng(4)
    middle = rng.integers(-10_000, 10_000, (8, 16))
    q = (middle[rng.integers(0, 8, 4000)] + rng.integers(-20, 20, (4000, 16))).astype(np.int64)
    balls, _ = bt.Balls.build(q)
    alone = sum(len(which) for which, _, whole in balls.walk(middle) if not whole)
    assert alone < 400
