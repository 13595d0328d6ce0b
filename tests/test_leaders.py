"""Leader clustering against the plain walk."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tracelake.operators import leaders


def plain(rows, threshold):
    """rows in order: (id, vector)."""
    cos = lambda x, y: 0.0 if not any(x) or not any(y) else sum(a * b for a, b in zip(x, y, strict=True)) / (sum(a * a for a in x) * sum(b * b for b in y)) ** 0.5
    clusters, out = [], {}
    for i, v in rows:
        best, like = None, 0.0
        for c in clusters:
            if cos(c[1], v) > like:
                best, like = c, cos(c[1], v)
        if best is not None and like >= threshold:
            best[2] += 1
            best[1] = [(a * (best[2] - 1) + b) / best[2] for a, b in zip(best[1], v, strict=True)]
            out[i] = best[0]
        else:
            clusters.append([i, list(v), 1])
            out[i] = i
    return out


@pytest.mark.parametrize("block", [7, 1000])
def test_clusters_are_those_of_the_plain_walk(spark, block):
    rng = random.Random(block)
    rows = [(i, "ab"[i % 3 == 0], rng.randrange(50), [rng.gauss(0, 1) + 2 * (j == i % 4) for j in range(5)], 9) for i in range(120)]
    rows += [(200, "b", 3, [0.0] * 5, 9), (201, "b", 60, [0.0] * 5, 9)]
    bad = [(300, None, 1, [1.0] * 5, 9), (None, "a", 1, [1.0] * 5, 9), (301, "a", 1, None, 9)]
    df = spark.createDataFrame(rows + bad, "id int, kind string, at int, vector array<double>, block int").repartition(3)
    want = {}
    for kind in "ab":
        mine = [(r[0], r[3]) for r in sorted((r for r in rows if r[1] == kind), key=lambda r: (r[2], r[0]))]
        for a in range(0, len(mine), block):
            want |= {i: (kind, a // block, leader) for i, leader in plain(mine[a : a + block], 0.6).items()}
    got = leaders.leader_clusters(df, "kind", "at", block=block).collect()
    assert {r.id: (r.bucket, r.block, r.leader) for r in got} == want and len(got) == len(rows)
    assert len({w[2] for w in want.values()}) < len(rows) * 0.8
    assert leaders.leader_clusters(df.limit(0), "kind", "at").count() == 0


def jaccard_walk(labels, rows, threshold):
    """labels: {name: tokens} in order; rows in order: (id, tokens)."""
    clusters, out = [[n, set(t)] for n, t in labels.items()], {}
    for i, tokens in rows:
        best, like = None, 0.0
        for c in clusters:
            s = len(c[1] & tokens) / len(c[1] | tokens) if c[1] and tokens else 0.0
            if s > like:
                best, like = c, s
        if best is not None and like >= threshold:
            best[1] |= tokens
            out[i] = best[0]
        else:
            clusters.append([i, set(tokens)])
            out[i] = i
    return out


@pytest.mark.parametrize("block", [9, 1000])
def test_words_cluster_like_the_plain_walk(spark, block):
    rng = random.Random(block)
    words = [f"w{i}" for i in range(30)]
    rows = [(f"{i:03}", "ab"[i % 4 == 0], rng.randrange(40), rng.choice([None, None, None, "l1", "l2"]), rng.sample(words, rng.randrange(0, 7))) for i in range(140)]
    df = spark.createDataFrame([*rows, (None, "a", 1, None, ["w1"]), ("900", None, 1, None, ["w1"]), ("901", "b", 99, None, None)], "id string, bucket string, ord int, label string, tokens array<string>").repartition(3)
    rows.append(("901", "b", 99, None, []))
    want = {}
    for bucket in "ab":
        mine = sorted((r for r in rows if r[1] == bucket), key=lambda r: (r[2], r[0]))
        labels = {}
        for r in mine:
            if r[3]:
                labels.setdefault(r[3], set()).update(r[4])
                want[r[0]] = (bucket, 0, r[3])
        alone = [(r[0], set(r[4])) for r in mine if not r[3]]
        for a in range(0, len(alone), block):
            want |= {i: (bucket, a // block, c) for i, c in jaccard_walk(labels, alone[a : a + block], 0.28).items()}
    got = leaders.lexical_clusters(df, block=block).collect()
    assert {r.id: (r.bucket, r.block, r.cluster) for r in got} == want and len(got) == len(rows)
    assert leaders.lexical_clusters(df.limit(0)).count() == 0


def test_a_task_holds_one_full_block_at_most(spark):
    rows = [(i, i % 2 if i < 400 else i, i) for i in range(800)]
    known = spark.createDataFrame(rows, "id int, bucket int, ord int").repartition(5)
    placed, parts = leaders._in_blocks(known, 40)
    blocks = placed.groupBy("part", "bucket", "block").agg(F.count("*").alias("n")).collect()
    by = {}
    for r in blocks:
        by.setdefault(r.part, []).append(r.n)
    assert sum(r.n for r in blocks) == 800 and max(by) < parts
    assert max(map(sum, by.values())) < 40 + 40 // 8 and sum(40 in v for v in by.values()) == 10
    # as they are dealt, so they are walked: no task is joined to others
    df = known.where("id < 400").select(F.col("bucket"), F.col("ord"), F.col("id").cast("string").alias("id"), F.lit(None).cast("string").alias("label"), F.array(F.concat(F.lit("w"), "id")).alias("tokens"))
    walked = leaders.lexical_clusters(df, block=40).withColumn("task", F.spark_partition_id())
    assert walked.groupBy("task").agg(F.count_distinct("bucket", "block").alias("n")).agg(F.max("n")).first()[0] == 1


def test_a_block_of_unlike_rows_is_walked_in_seconds():
    rng = random.Random(7)
    common = [f"c{i}" for i in range(40)]
    clusters = leaders.Growing(0.28)
    rows = [{*rng.sample(common, 8), *(f"r{rng.randrange(10**6)}" for _ in range(40))} for _ in range(8000)]
    began = time.process_time()
    told = [clusters.place(str(i), tokens) for i, tokens in enumerate(rows)]
    assert len(set(told)) == 8000
    # some 50 million shared tokens; one by one they took 18 seconds
    assert time.process_time() - began < 5
