"""Operators 5, 6, 8, 9 and 10 against brute force, on awkward and on empty tables."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelake.llm import bpe, components, decontamination, ngram_join, sharding, substring_dedup
from tracelake.llm import textkernel as tk

from . import cases


@pytest.fixture(scope="module")
def docs(spark):
    return cases.documents(spark).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


words = st.text(st.sampled_from("aBz09 .\t\n\x0b\x00\x1fé日"), max_size=30)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), words), max_size=8))
def test_kernel_words(texts):
    for classes, split in ((tk.SPACED, cases.spaced), (tk.SPACED_LOWER, lambda t: cases.spaced(t, True)), (tk.ALNUM_LOWER, cases.alnum)):
        got = []
        for w in tk.slices(pa.array(texts, pa.string()), classes):
            for d in range(w.n_docs):
                mine = [w.data[i:j].tobytes().decode() for i, j in zip(w.start[w.bounds[d] : w.bounds[d + 1]], w.end[w.bounds[d] : w.bounds[d + 1]], strict=True)]
                got.append([x.lower() if classes is not tk.SPACED else x for x in mine])
        assert got == [[x.lower() if classes is not tk.SPACED else x for x in split(t)] for t in texts]


def test_equal_words_have_equal_hashes_across_slices():
    a = next(iter(tk.slices(pa.array(["Alpha beta", "beta"]), tk.SPACED_LOWER)))
    assert a.hash[1] == a.hash[2] != a.hash[0]
    sliced = pa.array(["zz", "alpha"]).slice(1)
    assert next(iter(tk.slices(sliced, tk.SPACED_LOWER))).hash[0] == a.hash[0]


def test_jaccard(docs, rows, empty):
    got = ngram_join.jaccard_components(docs).collect()
    want = cases.jaccard_components(rows.items())
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == sorted([(d, *want[d]) for d in want] + [(11, *want[11])])
    assert [r.component_id for r in got if r.doc_id is None] == [None, None]
    assert want[2][1] == want[1][1] == 0 and want[7][1] == 6
    assert ngram_join.jaccard_components(empty).count() == 0


@pytest.mark.parametrize("elements", [ngram_join.BLOCK_ELEMENTS, 700])
def test_jaccard_families(spark, monkeypatch, elements):
    """Near copies in a chain and in a family larger than a small bucket, with pairs just below and above the threshold."""
    monkeypatch.setattr(ngram_join, "BLOCK_ELEMENTS", elements)  # the second: families in blocks
    rng = np.random.default_rng(3)
    rows = []
    for family in range(6):
        base = [f"f{family}v{i}" for i in range(120)]
        for copy in range(14):
            text = list(base)
            for _ in range(int(rng.integers(0, 9))):
                text[int(rng.integers(0, 120))] = f"n{rng.integers(1_000_000)}"
            rows.append((len(rows), " ".join(text)))
            if copy % 5 == 4:
                base = text
    want = cases.jaccard_components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    assert 6 < len({v[1] for v in want.values()}) < len(rows)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 20)), max_size=80), st.integers(1, 30))
def test_buckets_in_batches_of_any_size(rows, step):
    """Small buckets give all pairs, large ones a link of each member to the least; repeated rows and batch borders change nothing."""
    rows = sorted(rows)
    batch = pa.RecordBatch.from_arrays([pa.array([a + 1 for a, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.int64())], names=["sig", "c"])
    got = [r for out in ngram_join._bucket_pairs(batch.slice(at, step) for at in range(0, len(rows), step)) for r in zip(*(c.to_pylist() for c in out.columns), strict=True)]
    small, large = set(), []
    for sig in range(5):
        c = sorted({b for a, b in rows if a == sig})
        if len(c) > ngram_join.SMALL_BUCKET:
            large += [(x, c[0], sig + 1) for x in c]
        else:
            small |= {(x, y, 0) for x in c for y in c if x > y}
    assert {r for r in got if r[2] == 0} == small
    assert sorted(r for r in got if r[2]) == sorted(large)


@pytest.mark.parametrize("per_task", [components.EDGES_PER_TASK, 10])
def test_components(spark, per_task):
    """Chains, stars, loops, repeated edges and null ends, in one task and in rounds of contraction."""
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(1000, 1100)] + [(5, i) for i in range(200, 260)] + [(7, 7), (1, None), (None, 2), (9, 8), (9, 8), (8, 9)]
    edges += [tuple(map(int, rng.integers(2000, 2080, 2))) for _ in range(60)]
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5), per_task=per_task).collect()
    want = cases.roots({v for e in edges if None not in e for v in e}, [e for e in edges if None not in e])
    assert {r.id: r.component for r in got} == want and len(got) == len(want)
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), per_task=per_task).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 150), st.integers(0, 40), st.integers(0, 40), st.integers(0, 2**32))
def test_partenum_never_misses(n, drop, add, seed):
    """Similar sets share a signature, whatever the elements."""
    rng = np.random.default_rng(seed)
    pool = np.unique(rng.integers(0, 2**63, n + add + 1, dtype=np.int64)).astype(np.uint64)
    a = np.sort(pool[: min(n, len(pool))])
    b = np.sort(np.concatenate([rng.permutation(a)[: max(1, len(a) - drop)], pool[n : n + add]]))
    bands = ngram_join.Bands(ngram_join.Fraction(4, 5))
    if ngram_join.similar(a, b, 4, 5) and not np.array_equal(a, b):
        one, two = (np.concatenate([*ngram_join._signatures(s, bands), np.empty(0, np.uint64)]) for s in (a, b))
        assert len(np.intersect1d(one, two))
        assert ngram_join._may_link(len(a), np.frombuffer(ngram_join._sketch(a), np.uint8), len(b), np.frombuffer(ngram_join._sketch(b), np.uint8), bands)


def test_substring(docs, rows, empty):
    got = substring_dedup.remove_earlier_passages(docs, with_text=True, carry=("c", "spans")).collect()
    want = cases.without_earlier(rows.items())
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0
            continue
        n, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, n - len(kept), cases.sha(" ".join(kept))), r.doc_id
        assert r.text == (" ".join(kept) if r.n_removed else rows[r.doc_id])
        assert (r.c0, r.c1) == (1, 3)
    assert len(got) == docs.count()
    assert want[1][1] == [] and len(want[15][1]) == 1 and 0 < len(want[10][1]) < 10
    assert substring_dedup.remove_earlier_passages(empty).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=40), min_size=1, max_size=6))
def test_automaton_matching_statistics(texts):
    automaton, before = substring_dedup.SuffixAutomaton(), []
    for t in texts:
        for e, n in enumerate(automaton.matching_statistics(t), 1):
            fits = [k for k in range(e + 1) if k == 0 or any(t[e - k : e] == b[i : i + k] for b in before for i in range(len(b)))]
            assert n == max(fits)
        automaton.add(t)
        before.append(t)


ITEMS = [(1, " ".join(f"Passage{i}" for i in range(10, 24))), (2, "a b, C"), (3, None), (4, ""), (5, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14"), (6, "w0 w1 w2 w3 w4 w5 w6 w7 w8 other"), (5, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14"), (10, "same same same same same same same same same same")]


def test_contamination(spark, docs, rows, empty):
    items = spark.createDataFrame([(i, t, 0) for i, t in ITEMS], "item_id long, text string, h int")
    got = decontamination.contamination(docs, items).collect()
    want = cases.contamination(rows.items(), ITEMS)
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got if r.doc_id is not None} == want
    assert len(got) == docs.count() and not any(r.contaminated for r in got if r.doc_id is None)
    assert want[11][2] == 1 and want[9][1] == 14 and want[15][1] == 50
    assert decontamination.contamination(empty, items).count() == 0
    assert not any(r.contaminated for r in decontamination.contamination(docs, items.limit(0)).collect())


def test_winnowing_keeps_one_kgram_in_every_span():
    rng = np.random.default_rng(0)
    text = " ".join(rng.choice(list("abcd"), 400))
    w = next(iter(tk.slices(pa.array([text]), tk.ALNUM_LOWER)))
    at = tk.winnow(w, 5, 10)
    assert all(((at >= s) & (at <= s + 5)).any() for s in range(391))


def test_sharding(docs, empty, spark):
    got = sharding.stratified_shards(docs).collect()
    n = docs.count()
    assert len(got) == n
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(by.get(i, [])) for i in range(16)]
    assert max(sizes) - min(sizes) <= 1
    text = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id is not None}
    assert all((r.size, r.text_crc32) == (len(text[r.doc_id].encode()) + 1, zlib.crc32(text[r.doc_id].encode())) for r in got if r.doc_id is not None)
    assert sharding.stratified_shards(empty).count() == 0


def test_shards_match_the_mixture(spark):
    rows = [(i, "t", "big" if i % 3 else f"small{i % 5}") for i in range(3_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    was, sharding.ROWS_PER_PART = sharding.ROWS_PER_PART, 100  # several ranges to a stratum
    try:
        got = sharding.stratified_shards(df).collect()
    finally:
        sharding.ROWS_PER_PART = was
    for s in {r.stratum for r in got}:
        mine = [sum(r.stratum == s and r.shard == k for r in got) for k in range(16)]
        assert max(mine) - min(mine) <= 2, (s, mine)


@pytest.fixture(scope="module")
def vocabulary():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    return bpe.Vocabulary(ranks), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, empty, vocabulary):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = bpe.encode_decode(docs, path, public_tokenizers.PATTERN, with_ids=True).collect()
    text = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id is not None}
    for r in got:
        if r.doc_id is not None:
            ids = vocabulary[1].encode_ordinary(text[r.doc_id])
            assert r.ids == ids and r.n_tokens == len(ids) and r.lossless, r.doc_id
            assert r.ids_sha256 == cases.sha(np.array(ids, "<u4").tobytes()) and r.decoded_sha256 == cases.sha(text[r.doc_id])
    assert len(got) == docs.count()
    assert bpe.encode_decode(empty, path, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(st.one_of(st.sampled_from("etaoin shr'sLD019!\n\t \x1c　"), st.characters(exclude_categories=["Cs"])), max_size=200))
def test_bpe_is_tiktoken(vocabulary, text):
    e = bpe.Encoder(vocabulary[0], public_tokenizers.PATTERN)
    assert np.frombuffer(e.encode([text])[0], "<u4").tolist() == vocabulary[1].encode_ordinary(text)


def test_long_pieces_and_cache(vocabulary, monkeypatch):
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("aeinorst"), n)) for n in (127, 128, 129, 700, 5000)]
    monkeypatch.setattr(bpe, "CACHE", 2)
    e = bpe.Encoder(vocabulary[0], public_tokenizers.PATTERN)
    for t in texts * 2:
        assert np.frombuffer(e.encode([t])[0], "<u4").tolist() == vocabulary[1].encode_ordinary(t)
