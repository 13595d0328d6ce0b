"""Operators 1, 2, 3, 4 and 7, and the pipeline."""

import base64
import hashlib
import os
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tracelake.llm import bpe, embedding_dedup, language_id, queries, toxicity, url_filter, warc

from . import cases


# --- embeddings


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, links int, copies int").repartition(3)


def brute(rows, threshold=0.95):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 8:
            x = np.array(v, np.float32).astype(float)
            good[i] = x / np.linalg.norm(x)
    ids = sorted(good)
    near = [(a, b) for a in ids for b in ids if a != b and good[a] @ good[b] >= threshold]
    root = cases.roots(ids, near)
    return {i: (sum(a == i for a, _ in near), root.get(i, i)) for i in {i for i, _ in rows} - {None}}


def test_near_vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 8))
    rows = [(i, base[i % 40] + rng.normal(size=8) * (0.02 if i % 3 else 0.3)) for i in range(300)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    rows += [(300 + k, rows[0][1]) for k in range(5)] + [rows[7], (400, None), (401, [0.0] * 8), (402, [float("nan")] + [1.0] * 7), (403, [None] + [1.0] * 7), (404, [float("inf")] * 8), (405, [1.0, 0.0]), (None, rows[0][1]), (406, [])]
    got = embedding_dedup.near_duplicates(vectors(spark, rows), target=0.995).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    found = sum(r.n_links for r in got if r.vec_id is not None and r.vec_id not in (7,))
    exact = sum(n for i, (n, _) in want.items() if i != 7)
    assert 0.97 * exact <= found <= exact and exact > 500
    for r in got:
        if r.vec_id in (400, 401, 402, 403, 404, 405, 406):
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
        elif r.vec_id is not None:
            assert r.n_links <= want[r.vec_id][0] and r.kept == (r.component_id == r.vec_id)
    assert embedding_dedup.near_duplicates(vectors(spark, rows).limit(0)).count() == 0
    assert [r.n_links for r in embedding_dedup.near_duplicates(vectors(spark, [(1, [2.0]), (2, [-3.0]), (3, [0.5])])).orderBy("vec_id").collect()] == [1, 0, 1]


def test_links_are_counted_once_across_blocks(spark, monkeypatch):
    """One group that fills several blocks: every vector sees all others, however visits and blocks fall."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(1)
    centre = rng.normal(size=8)
    rows = [(i, [float(x) for x in centre + rng.normal(size=8) * 0.01]) for i in range(120)] + [(1000 + i, [float(x) for x in rng.normal(size=8)]) for i in range(60)]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(vectors(spark, rows)).collect()}
    want = brute(rows)
    assert all(got[i].n_links == want[i][0] and got[i].component_id == want[i][1] for i in range(120))


def test_recall_on_the_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    noisy = rows + [(10_000 + i, [x + float(e) for x, e in zip(v, np.random.default_rng(i).normal(size=len(v)) * 0.035, strict=True)]) for i, v in rows[:300]]
    x = np.array([v for _, v in noisy], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    exact = int((x @ x.T >= 0.95).sum()) - len(x)
    got = embedding_dedup.near_duplicates(spark.createDataFrame(noisy, "vec_id long, embedding array<float>")).agg(F.sum("n_links")).first()[0]
    assert exact > 300 and 0.9 * exact <= got <= exact


# --- URLs


def test_url_parts_and_rules(spark):
    urls = {
        1: "HTTP://Www.Example.NET/en/a?x#y", 2: "http://example.com/de/", 3: "https://a.b.org/fr/x", 4: "http://foo.net/x", 5: "http://foo.net", 6: None, 7: "nonsense", 8: "a://h?q://z/de/", 9: "http://notexample.com/de/x", 10: "http://x.example.com/DE/", 11: "", 12: "http://example.net/en",
    }
    df = spark.createDataFrame([(i, u, "t", "k") for i, u in urls.items()], "page_id long, url string, tokens string, key string")
    rules = url_filter.mine(spark.createDataFrame([], "url string, blocked boolean"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, rules).collect()}
    assert got[1] == ("www.example.net", "/en/a", "example.net/en/", "allow")
    assert got[2] == ("example.com", "/de/", "example.com/de/", "block")
    assert got[3] == ("a.b.org", "/fr/x", "org/fr/", "allow")
    assert got[4][2:] == ("net/", "block") and got[5] == ("foo.net", "", None, "allow")
    assert got[6] == got[7] == got[11] == ("", "", None, "allow")
    assert got[8] == ("h", "", None, "allow") and got[9][2] is None and got[10][2:] == (None, "allow")
    assert got[12][2:] == ("net/", "block")
    assert url_filter.judge(df.limit(0), rules).count() == 0


def test_mined_rules_block_their_combination_only(spark):
    rows = []
    for i in range(400):
        host, path = ("ads", "shop")[i % 2], ("promo", "news")[i // 2 % 2]
        rows.append((f"http://{host}.example.org/{path}/{i}?id={i}", host == "ads" and path == "promo"))
    rows += [(None, True), ("http://x.org/", None)]
    rules = url_filter.mine(spark.createDataFrame(rows, "url string, blocked boolean"))
    assert all(r.confidence >= 0.6 and r.lift > 1 and r.key in r.tokens for r in rules.collect()) and rules.count()
    pages = spark.createDataFrame([(1, "http://ads.other.com/promo/9"), (2, "http://ads.other.com/news/9"), (3, "http://shop.other.com/promo/9"), (3, "http://shop.other.com/promo/9")], "page_id long, url string")
    assert sorted((r.page_id, r.verdict) for r in url_filter.judge(pages, rules).collect()) == [(1, "block"), (2, "allow"), (3, "allow"), (3, "allow")]


# --- WARC


PAGES = [(1, "http://a/\r\nx", "same"), (2, "http://b/", "same"), (3, None, ""), (4, "http://d/", None), (5, "http://e/", "é" * 70_000), (6, "http://f/", "\x1f\x8b\x08 WARC/1.0\r\n\r\nWARC/1.1"), (2, "http://b/", "same"), (7, "http://g/", "x" * 10)]


def pages(spark):
    return spark.createDataFrame([(i, u, h, "f", 1) for i, u, h in PAGES], "page_id long, url string, html string, file string, records int").repartition(2)


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip(spark, tmp_path):
    manifest = warc.write_archives(pages(spark), f"file://{tmp_path}/w")
    assert sum(r.records for r in manifest.collect()) == len(PAGES)
    records = warc.read_archives(spark, manifest, with_payload=True).cache()
    assert not records.where("kind = 'gap'").count()
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.resolve(records).collect())
    first = {1: "1", 2: "1", 3: "3", 4: "3"}
    assert [g[:3] for g in got] == sorted((str(i), len((h or "").encode()), b32(h)) for i, _, h in PAGES)
    assert {(g[0], g[3], g[4]) for g in got} == {(str(i), "response" if first.get(i, str(i)) == str(i) else "revisit", None if first.get(i, str(i)) == str(i) else first[i]) for i, _, _ in PAGES}
    assert {r.page_id: bytes(r.payload).decode() for r in records.collect() if r.kind == "response"}["5"] == "é" * 70_000
    assert warc.write_archives(pages(spark).limit(0), f"file://{tmp_path}/e").count() == 0


def salvage(path, data):
    path.write_bytes(data)
    with pa.OSFile(str(path), "rb") as f:
        s = warc.Salvage(f)
        return [r.headers["warc-page-id"] for r in s], s.gaps


def test_salvage_skips_what_is_broken(tmp_path):
    m = [warc._member(str(i), "u", bytes([65 + i]) * 3000, warc.base32_sha1(bytes([65 + i]) * 3000), None, "d") for i in range(5)]
    whole = b"".join(m)
    at = np.cumsum([0, *map(len, m)]).tolist()
    assert salvage(tmp_path / "a", whole) == (list("01234"), [])
    bad = bytearray(whole)
    bad[at[2] + 40] ^= 0xFF  # inside a member
    ids, gaps = salvage(tmp_path / "b", bytes(bad))
    assert ids == list("0134") and [(a, b) for a, b, _ in gaps] == [(at[2], at[3])]
    ids, gaps = salvage(tmp_path / "c", b"junk" + whole[:-20])
    assert ids == list("0123") and [(a, b) for a, b, _ in gaps] == [(0, 4), (4 + at[4], 4 + at[5] - 20)]
    bad = bytearray(whole)
    bad[at[1]] = 0  # the magic itself
    assert salvage(tmp_path / "d", bytes(bad))[0] == list("0234")
    plain = [zlib.decompress(x, 31) for x in m]
    ids, gaps = salvage(tmp_path / "e", plain[0] + m[1] + plain[2].replace(b"WARC/1.1", b"WORC/1.1", 1) + plain[3])
    assert ids == list("013") and len(gaps) == 1 and gaps[0][1] - gaps[0][0] == len(plain[2])
    wrong = plain[1].replace(b"B" * 10, b"C" * 10, 1)  # right lengths, wrong digest
    assert salvage(tmp_path / "f", plain[0] + wrong + plain[2])[0] == list("02")
    assert salvage(tmp_path / "g", b"") == ([], [])
    assert salvage(tmp_path / "h", b"x" * 10)[1][0][:2] == (0, 10)


# --- language


def corpus(spark):
    rng = np.random.default_rng(2)
    parts = {"aa": ["the", "and", "ing", "wh", "sh"], "bb": ["ção", "que", "lh", "ões", "nh"], "cc": ["sch", "ung", "ein", "ö", "cht"]}
    rows = []
    for i in range(240):
        lang = list(parts)[i % 3]
        text = " ".join("".join(rng.choice(parts[lang], 3)) for _ in range(int(rng.integers(3, 40))))
        rows.append((i, text if i % 2 else text.upper(), None if i == 9 else lang, "s", len(text), 1))
    rows += [(240, None, "aa", "s", 0, 1), (241, "12 !!", "aa", "s", 5, 1), (242, "", None, "s", 0, 1), (None, "the and", "bb", "s", 7, 1), (243, "the sh " * 90_000, "aa", "s", 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, gram int").repartition(3)


def test_languages(spark):
    docs = corpus(spark)
    model = language_id.fit(docs)
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    right = [got[i].lang_pred == ["aa", "bb", "cc"][i % 3] for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean(right) > 0.95 and all(0 <= r.score <= 1 for r in got.values())
    assert [(got[i].lang_pred, got[i].score) for i in (240, 241, 242)] == [("und", 0.0)] * 3
    assert got[243].lang_pred == "aa" and got[None].lang_pred in ("aa", "bb", "cc")
    kept = language_id.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3
    nothing = language_id.fit(docs.limit(0))
    assert {r.lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), model).count() == 0


def test_code_lengths_are_those_of_the_context_trees(spark):
    texts = {"a": [b"abcabcabd", b"aab"], "b": [b"xyzzy"]}
    lang, gram, count = [], [], []
    for i, name in enumerate(texts):
        g, n = np.unique(language_id._grams(texts[name])[0], return_counts=True)
        lang += [i] * len(g)
        gram += g.tolist()
        count += n.tolist()
    model = language_id.Model.from_counts(["a", "b"], np.array(lang), np.array(gram, np.uint64), np.array(count))

    def bits(text, trained):
        seen = {}
        for t in trained:
            t = bytes(4) + t
            for i in range(4, len(t)):
                for o in range(5):
                    ctx = seen.setdefault(t[i - o : i], {})
                    ctx[t[i]] = ctx.get(t[i], 0) + 1
        t, total = bytes(4) + text, 0.0
        for i in range(4, len(t)):
            for o in range(4, -2, -1):
                if o < 0:
                    total += 8
                    break
                ctx = seen.get(t[i - o : i])
                if ctx is None:
                    continue
                whole = sum(ctx.values()) + len(ctx)
                if t[i] in ctx:
                    total -= np.log2(ctx[t[i]] / whole)
                    break
                total -= np.log2(len(ctx) / whole)
        return total

    probes = [b"abcab", b"", b"zzz", b"qabd\xff", b"xyzzyxabc"]
    got = model.code_lengths(probes)
    assert np.allclose(got, [[bits(p, texts["a"]), bits(p, texts["b"])] for p in probes])
    parts = language_id.SLICE_BYTES
    try:
        language_id.SLICE_BYTES = 3
        assert np.allclose(model.code_lengths(probes), got)
    finally:
        language_id.SLICE_BYTES = parts


# --- toxicity


def test_toxicity_from_positives_and_unlabelled(spark):
    rng = np.random.default_rng(4)
    common = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        words = list(rng.choice(common, int(rng.integers(20, 120))))
        bad = i % 5 == 0
        if bad:
            words += list(rng.choice(["vile", "nasty", "scumX"], 6))
        rows.append((i, " ".join(words), 1, "x"))
        if i % 2 == 0:
            labels.append((i, 1, int(bad)))
    rows += [(1000, None, 1, "x"), (1001, "", 1, "x"), (None, "w1", 1, "x"), (1002, "vile nasty scumX", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind int, features string").repartition(3)
    marks = spark.createDataFrame([*labels, (1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, marks)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2]
    caught = np.mean([got[i].predicted for i in held if i % 5 == 0])
    false = np.mean([got[i].predicted for i in held if i % 5])
    assert caught > 0.9 and false < 0.05
    assert got[1000].score == got[1001].score and got[1002].predicted == 1 and all(0 <= r.score <= 1 for r in got.values())
    assert {r.predicted for r in toxicity.score(docs, toxicity.fit(docs, marks.limit(0))).collect()} == {0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_risk_correction_is_used():
    """All unlabelled rows are positives: without the correction they'd be learned as negatives."""
    use = np.ones(1 << toxicity.BITS, bool)
    p = toxicity.Rows([np.array([1, 2])] * 20, use)
    u = toxicity.Rows([np.array([1, 2])] * 9 + [np.array([3, 4])], use)
    w, b = toxicity.train(p, u, 0.9, seed=0, steps=200)
    assert (p.dot(w) + b).mean() > 0 > toxicity.Rows([np.array([3, 4])], use).dot(w)[0] + b


# --- queries and pipeline


def test_contract_columns(spark, sf):
    want = {
        "op1": "vec_id n_links component_id kept", "op2": "page_id host path rule verdict", "op3": "page_id payload_bytes payload_digest record_type refers_to", "op4": "doc_id held_out score predicted",
        "op5": "doc_id n_words n_hit n_items items_sha256 contaminated", "op6": "doc_id size text_crc32 law shard slot grown_shard", "op7": "doc_id held_out lang_pred score", "op8": "doc_id n_tokens ids_sha256 decoded_sha256", "op9": "doc_id n_words n_removed kept_sha256", "op10": "doc_id n_shingles component_id",
        "op11": "doc_id n_words n_base first_word last_word base_labels labels score", "op12": "anchor_id positive_id rank negative_id positive_score negative_score", "op13": "vec_id cluster distance cluster_inertia inertia centroid_sha256",
    }
    for name, f in queries.QUERIES.items():
        if name.split("_")[0] not in ("op1", "op4"):  # those fit before they return
            assert set(want[name.split("_")[0]].split()) <= set(f(spark, sf).columns), name


def test_pipeline_is_the_brute_force_one(spark, sf):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = {d: t for d, t in rows.items() if t and regex.search(r"\p{L}", t)}
    comp = cases.jaccard_components(rows.items())
    rows = {d: t for d, t in rows.items() if comp[d][1] == d}
    left = cases.without_earlier(rows.items())
    rows = {d: t if left[d][0] == len(left[d][1]) else " ".join(left[d][1]) for d, t in rows.items()}
    hit = cases.contamination(rows.items(), items)
    rows = {d: t for d, t in rows.items() if not hit[d][4]}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got.keys() == rows.keys()
    for d, t in rows.items():
        ids = enc.encode_ordinary(t)
        assert got[d] == (len(ids), cases.sha(np.array(ids, "<u4").tobytes()), cases.sha(t))


def test_stages_keep_the_columns_and_stand_awkward_rows(spark, tmp_path):
    docs = cases.documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    sf_dir = str(tmp_path)
    spark.createDataFrame([(1, "a b c d")], "item_id long, text string").coalesce(1).write.parquet(f"{sf_dir}/benchmark.parquet")
    for df in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, sf_dir)
            assert out.dtypes == df.dtypes
            out.write.mode("overwrite").parquet(f"{sf_dir}/out")
    assert os.path.exists(f"{sf_dir}/out")
