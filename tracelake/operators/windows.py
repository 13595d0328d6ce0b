"""Row windows over runs: chunks, segments, budgets, spans, occurrence counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import numbered

def _run():
    return Window.partitionBy("trace_id")


def chunks(runs: DataFrame, size: int) -> DataFrame:
    """Consecutive blocks of ``size`` events."""
    rows = runs.withColumn("chunk", F.floor(F.col("pos") / size).cast("int"))
    return rows.groupBy("trace_id", "chunk").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def segments(runs: DataFrame, start: str, excluded: str) -> DataFrame:
    """A segment starts at each event where ``start`` holds; one with an ``excluded`` event is left out whole."""
    rows = runs.withColumn("segment", F.sum(F.when(F.expr(start), 1).otherwise(0)).over(_run().orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    bad = F.bool_or(F.expr(excluded)).over(Window.partitionBy("trace_id", "segment"))
    return rows.withColumn("bad", bad).where("not bad").groupBy("trace_id", "segment").agg(F.count("*").alias("n"))


def size_budget(runs: DataFrame, size: str, cap: int) -> DataFrame:
    """Events until the running size would pass the cap, renumbered."""
    total = F.sum(F.expr(size)).over(_run().orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    kept = runs.withColumn("running", total.cast("long")).where(F.col("running") <= cap)
    return kept.select("trace_id", "event_id", "running", (F.row_number().over(_run().orderBy("pos")) - 1).alias("step_index"))


def head_tail(runs: DataFrame, k: int = 7) -> DataFrame:
    """The first and last k events of runs of more than 2k."""
    n = F.count("*").over(_run())
    rows = runs.select("trace_id", "event_id", "pos", n.alias("n"))
    return rows.where((F.col("n") <= 2 * k) | (F.col("pos") < k) | (F.col("pos") >= F.col("n") - k))


def occurrences(runs: DataFrame) -> DataFrame:
    """0-based count of each payload's occurrence within a run and type, in order."""
    w = Window.partitionBy("trace_id", "event_type", "payload").orderBy("pos")
    return runs.select("trace_id", "event_id", (F.row_number().over(w) - 1).alias("nth"))


def last_emitted(runs: DataFrame, kind: str = "tool.call") -> DataFrame:
    """The most recent event of a kind before each event."""
    w = _run().orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return runs.select("trace_id", "event_id", F.last(F.when(F.col("event_type") == kind, F.col("event_id")), ignorenulls=True).over(w).alias("parent_id"))


def around(runs: DataFrame, marked: DataFrame, k: int) -> DataFrame:
    """Events within k steps of a marked position of their run, by a windowed search instead of a range join."""
    marks = marked.select("trace_id", "pos").distinct()
    rows = runs.join(marks.withColumn("mark", F.col("pos")), ["trace_id", "pos"], "left")
    w = _run().orderBy("pos").rangeBetween(-k, k)
    return rows.withColumn("near", F.count("mark").over(w)).where("near > 0").select("trace_id", "event_id", "near")


def round_robin(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Sorted items to annotators in turn."""
    return numbered(rows.select(key).distinct(), key).select(key, (F.col("place") % n).cast("int").alias("annotator"))
