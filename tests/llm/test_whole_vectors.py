"""Vectors of every length are compared with those of their length."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelake.llm import embedding_dedup


def test_each_length_is_indexed(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8 if i < 60 else 5)]) for i in range(100)]
    rows[59] = (59, rows[3][1])
    rows[98] = (98, [2 * x for x in rows[70][1]])
    rows[99] = (99, rows[70][1])
    rows += [(200, [1.0, 2.0]), (201, None), (202, [0.0] * 5)]
    cos = lambda x, y: sum(a * b for a, b in zip(x, y)) / (sum(a * a for a in x) * sum(b * b for b in y)) ** 0.5
    good = {i: v for i, v in rows if v and any(v)}
    links = {i: {j for j in good if j != i and len(good[j]) == len(good[i]) and cos(good[i], good[j]) >= 0.95} for i in good}
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert len(got) == len(rows) and {98, 99} <= links[70] and 59 in links[3]
    assert {i: r.n_links for i, r in got.items()} == {i: len(links.get(i, ())) for i in got}
    assert [got[i].component_id for i in (3, 59, 70, 98, 99)] == [3, 3, 70, 70, 70] and not got[99].kept


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(1, 90), st.integers(0, 2**32))
def test_traversal_visits_the_nearest_cells(k, m, visits, seed):
    """The multi-sequence traversal gives the cells that a sort of the whole grid gives."""
    rng = np.random.default_rng(seed)
    index = embedding_dedup.MultiIndex(rng.normal(size=(k, 3)), rng.normal(size=(m, 3)), 1)
    x = rng.normal(size=(7, 6))
    got = index.order(x, visits)
    a, b = embedding_dedup._distances(x[:, :3], index.first), embedding_dedup._distances(x[:, 3:], index.second)
    want = np.argsort((a[:, :, None] + b[:, None, :]).reshape(7, -1), axis=1)[:, :visits]
    assert np.array_equal(got, want)


def test_visits_grow_with_the_vectors():
    """Rows dealt to blocks: with four times the vectors about four times as many, not sixteen."""
    rng = np.random.default_rng(0)
    rows = []
    for n in (20_000, 80_000):
        x = rng.normal(size=(n, 16))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        index = embedding_dedup.MultiIndex.fit(x[:4096], n, 0.95, 0.9)
        cells = np.concatenate([index.order(x[at : at + 2048], 12) for at in range(0, n, 2048)])
        cell, count = np.unique(cells[:, 0], return_counts=True)
        first, parts = embedding_dedup._blocks(cell, count, len(index.second), len(index.first) * len(index.second))
        row, block, visitor = embedding_dedup._addresses(cells, np.arange(n), first, parts)
        assert np.bincount(block[visitor == 0]).max() <= 1.2 * embedding_dedup.BLOCK
        rows.append(len(row))
    assert rows[1] <= 5 * rows[0]
