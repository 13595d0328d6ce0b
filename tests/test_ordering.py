"""Whole-list numbers and neighbours in blocks, against plain sorting and all pairs."""

import random
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelake.functions.text import cosine
from tracelake.operators import lessons, memory, ordering, stores, windows


def test_numbers_over_ranges(spark):
    rng = random.Random(0)
    rows = [(rng.randrange(40), f"n{i}") for i in range(500)] + [(None, "none"), (None, "nil")]
    df = spark.createDataFrame(rows, "a int, b string").repartition(7)
    got = sorted(ordering.numbered(df, F.desc("a"), "b").collect(), key=lambda r: r.place)
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [(r.a, r.b, r.place) for r in got] == [(*w, i) for i, w in enumerate(want)]
    assert ordering.numbered(df.limit(0), "a").count() == 0
    assert stores.newest_first(df, "a", "b").where("place = 0").first().a == 39
    turns = {r.b: r.annotator for r in windows.round_robin(df, "b", 3).collect()}
    assert turns == {b: i % 3 for i, b in enumerate(sorted(b for _, b in rows))}


@pytest.mark.parametrize("block", [5, 4096])
def test_neighbours_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(memory, "BLOCK", block)
    rng = random.Random(block)
    rows = [(i, i % 3, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    cos = lambda x, y: sum(a * b for a, b in zip(x, y, strict=True)) / (sum(a * a for a in x) * sum(b * b for b in y)) ** 0.5
    want = {}
    for i, g, v in rows:
        near = sorted((-cos(v, w), j) for j, h, w in rows if h == g and j != i and cos(v, w) >= 0.2)[:3]
        want |= {(i, j): k for k, (_, j) in enumerate(near, 1)}
    df = spark.createDataFrame(rows, "id int, g int, vector array<double>")
    assert {(r.a, r.b): r.rank for r in memory.neighbours(df, df, "g", 3, 0.2).collect()} == want


def test_neighbours_of_copies_and_odd_vectors_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(memory, "BLOCK", 40)
    monkeypatch.setattr(memory, "HELD", 200)
    rng = random.Random(4)
    nan, inf = float("nan"), float("inf")
    kinds = [[rng.gauss(0, 1) for _ in range(3)] for _ in range(6)]
    vectors = [kinds[i % 6] if i % 2 else [x * (1 + i % 5) for x in kinds[i % 6]] if i % 3 else [rng.gauss(0, 1) for _ in range(3)] for i in range(150)]
    vectors += [[0.0] * 3, None, [1.0, None, 0.5], [nan, 0.0, 1.0], [inf, 1.0, 1.0], [1.0, 0.0], [2.0, 0.1], [1e-150, 1e-150, 0.0], [1e-170, 0.0, 0.0], [1e160, 0.0, 1.0], []]
    rows = [(f"v{i:03}", None if i == 140 else i % 2, v) for i, v in enumerate(vectors)] + [(None, 0, [1.0, 0.0, 0.0]), ("v007", 1, [0.5, 0.5, 0.5]), ("v008", 0, [0.5, 0.5, 0.5])]
    df = spark.createDataFrame(rows, "id string, g int, vector array<float>").cache()
    for k, least in ((3, 0.2), (1, 0.9), (4, 0.0), (2, -1.0)):
        pairs = df.select(F.col("id").alias("a"), "g", F.col("vector").alias("va")).join(df.select(F.col("id").alias("b"), "g", F.col("vector").alias("vb")), "g").where("a <> b")
        pairs = pairs.select("a", "b", cosine(F.col("va"), F.col("vb")).alias("cosine")).where(F.col("cosine") >= least)
        near = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))).where(F.col("rank") <= k)
        want = sorted(map(repr, near.collect()))
        assert sorted(map(repr, memory.neighbours(df, df, "g", k, least).collect())) == want
        told = lessons.retrieve(df.where("id < 'v050'").withColumnRenamed("g", "bucket"), df.withColumnRenamed("g", "bucket"), k, least)
        assert sorted(map(repr, told.toDF("a", "b", "cosine", "rank").collect())) == sorted(map(repr, near.where("a < 'v050'").collect()))
    assert memory.neighbours(df.limit(0), df, "g", 3, 0.2).count() == 0


def test_a_bucket_of_thousands_is_compared_by_products(spark):
    rng = random.Random(5)
    rows = [(i, 0, [rng.gauss(0, 1) for _ in range(16)]) for i in range(6000)]
    df = spark.createDataFrame(rows, "id int, g int, vector array<double>").repartition(4).cache()
    df.count()
    began = time.monotonic()
    assert memory.neighbours(df, df, "g", 3, 0.2).count() == 18000
    # 36 million pairs; by a row a pair they took minutes
    assert time.monotonic() - began < 45


def test_many_queries_meet_a_bucket_of_lessons_by_products(spark):
    rng = random.Random(6)
    rows = [(i, 0, [rng.gauss(0, 1) for _ in range(16)]) for i in range(30000)]
    df = spark.createDataFrame(rows, "id int, bucket int, vector array<double>").repartition(4).cache()
    df.count()
    began = time.monotonic()
    assert lessons.retrieve(df.where("id % 20 = 0"), df, 3, 0.2).count() == 4500
    # 45 million pairs
    assert time.monotonic() - began < 45
