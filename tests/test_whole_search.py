"""No passing run is left out of the search for a reference."""

import random

from pyspark.sql import functions as F

from tracelake.operators import attribute
from tracelake.plans import catalog

RUN = "trace_id string, pos int, agent_name string, event_type string, payload string"


def test_reference_is_the_longest_prefix_of_all_passing_runs(spark):
    rng = random.Random(3)
    failed = {f"f{i}": rng.choices("ab", k=rng.randrange(9)) for i in range(12)}
    passing = {f"r{i:02}": rng.choices("ab", k=rng.randrange(9)) for i in range(30)}
    failed["f99"] = passing["r29"] + list("zzzz")
    passing["r99"] = failed["f99"][:-1]
    rows = [(t, 2 * i + 1, "a", "tool.call", x) for t, seq in {**failed, **passing}.items() for i, x in enumerate(seq)]
    flag = spark.createDataFrame([(t, t in failed) for t in [*failed, *passing]], "trace_id string, failed boolean")
    runs = spark.createDataFrame(rows, RUN)

    def common(x, y):
        return next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))

    want = []
    for t, x in failed.items():
        n, r = min((-common(x, y), r) for r, y in passing.items())
        want.append((t, r, -n, 2 * -n + 1 if -n < len(x) else None))
    got = attribute.longest_prefix_references(runs, flag)
    assert sorted(tuple(r) for r in got.select("failed", "reference", "aligned", "divergence_step").collect()) == sorted(want)
    assert ("f99", "r99", len(failed["f99"]) - 1) in [w[:3] for w in want]
    assert attribute.longest_prefix_references(runs, flag.where("failed")).count() == 0


def test_registered_search_takes_all_passing_runs(spark, sf):
    best = catalog.QUERIES["attribute_best_reference"](spark, sf)
    five = catalog.QUERIES["attribute_best_reference"](spark, sf).select("failed", F.col("aligned").alias("least"))
    assert best.join(five, "failed").where("aligned < least").count() == 0
    assert best.count() == catalog.QUERIES["detect_failed_runs"](spark, sf).where("failed").count()
