"""Stores written and read again: appends keep duplicates, lookups take the last, upserts replace."""

from tracelake.operators import stores


def test_append_keeps_duplicates_and_lookup_takes_the_last(spark, tmp_path):
    path = f"file://{tmp_path}/traces"
    for n, goal in enumerate(("first", "second")):
        stores.append(spark.createDataFrame([("t", n, goal)], "trace_id string, n int, goal string"), path)
    kept = spark.read.schema("trace_id string, n int, goal string").json(path)
    assert kept.count() == 2
    assert [tuple(r) for r in stores.last_written(kept, "trace_id", "n").select("trace_id", "goal").collect()] == [("t", "second")]


def test_upsert_replaces_by_key(spark):
    schema = "trace_id string, updated_at int, goal string"
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], schema)
    new = spark.createDataFrame([("b", 3, "z"), ("b", 2, "w"), ("c", 1, "v")], schema)
    assert sorted(tuple(r) for r in stores.upsert(old, new, "trace_id").select("trace_id", "goal").collect()) == [("a", "x"), ("b", "z"), ("c", "v")]


def test_sequences_go_on(spark):
    old = spark.createDataFrame([("d", 4)], "discussion string, sequence int")
    new = spark.createDataFrame([("d", "m1", 1), ("d", "m2", 2), ("e", "m3", 1)], "discussion string, text string, at int")
    assert sorted((r.text, r.sequence) for r in stores.next_sequence(old, new, "discussion", "at").collect()) == [("m1", 5), ("m2", 6), ("m3", 1)]
