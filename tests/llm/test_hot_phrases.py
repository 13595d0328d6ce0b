"""Winnowing where a phrase and a one-word item are in every document: equal to brute force, with heavy keys dealt over shares."""

import random

from pyspark.sql import functions as F

from tracelake.llm import decontamination

from . import cases

PHRASE = "at the end of the"
PASSAGE = "one two three at the end of the road there stands a house"


def corpus():
    rng = random.Random(3)
    word = lambda: f"v{rng.randrange(40)}"
    rows = []
    for d in range(90):
        around = [word() for _ in range(rng.randrange(0, 30))]
        middle = PASSAGE if d % 7 == 0 else " ".join(PASSAGE.split()[d % 4 : d % 4 + 10]) if d % 7 == 1 else PHRASE
        rows.append((d, " ".join([*around, middle, *(word() for _ in range(d % 5)), "the"])))
    return rows + [(90, PHRASE), (91, ""), (92, None), (93, PASSAGE + " " + PASSAGE), (94, f"{PHRASE} road there stands a"), (95, f"one two three {PHRASE} x y")]


ITEMS = [(1, PASSAGE), (2, "the"), (3, f"a b c {PHRASE} d e f"), (4, f"{PHRASE} road there stands a"), (5, f"v1 v2 v3 v4 v5 {PHRASE}"), (6, PASSAGE), (7, PHRASE), (8, f"one two three {PHRASE} road there")]


def result(spark, span=10):
    docs, items = spark.createDataFrame(corpus(), "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontamination.contamination(docs, items, span=span).collect()}


def test_hot_phrases(spark, monkeypatch):
    want = cases.contamination(corpus(), ITEMS)
    assert want[0][2] >= 4 and want[2][2] >= 2
    assert result(spark) == want
    monkeypatch.setattr(decontamination, "HOT_ROWS", 3)
    assert result(spark) == want
    # spans of other lengths than the default, down to that of a fingerprint
    for span in (5, 6, 7, 13):
        assert result(spark, span) == cases.contamination(corpus(), ITEMS, span)


def test_a_heavy_key_is_dealt_over_shares(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "HOT_ROWS", 10)
    hits = spark.range(1000).select(F.when(F.col("id") < 800, 7).otherwise(F.col("id")).cast("long").alias("key"), F.col("id").alias("doc_id"), F.lit(0).alias("at"))
    prints = spark.createDataFrame([(7, "a"), (7, "b"), (900, "c"), (5, "d")], "key long, item_id string")
    met = decontamination._met(hits, prints)
    by = {(r.key, r.share): r["count"] for r in met.where("item_id <> 'b'").groupBy("key", "share").count().collect()}
    assert met.count() == 1601 and sum(n for (k, _), n in by.items() if k == 7) == 800 and by[900, 0] == 1
    assert len([k for k in by if k[0] == 7]) == 80 and max(by.values()) < 40
