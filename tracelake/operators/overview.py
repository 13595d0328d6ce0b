"""Corpus overview: counts, stages, histograms and priorities over all runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def run_summary(runs: DataFrame, found: DataFrame) -> DataFrame:
    """Per run: events, errors, findings, first finding's position, whole milliseconds."""
    by = runs.groupBy("trace_id").agg(F.count("*").alias("n_events"), F.count_if(F.col("error").isNotNull()).alias("n_errors"), F.sum(F.col("duration_ms").cast("long")).alias("total_ms"))
    hit = found.groupBy("trace_id").agg(F.count("*").alias("n_findings"), F.min("pos").alias("first_pos"))
    return by.join(hit, "trace_id", "left").withColumn("n_findings", F.coalesce("n_findings", F.lit(0)))


def kpis(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.count("*").alias("runs"),
        F.count_if(F.col("n_findings") > 0).alias("runs_with_findings"),
        F.round(100 * F.coalesce(F.try_divide(F.count_if(F.col("n_findings") > 0), F.count("*")), F.lit(0.0)), 1).alias("error_rate"),
        F.min("n_events").alias("min_events"),
        F.max("n_events").alias("max_events"),
        F.round(F.avg("n_events"), 1).alias("avg_events"),
        F.round(F.avg("n_findings"), 1).alias("avg_findings"),
        F.round(F.avg("first_pos"), 1).alias("avg_first_pos"),
    )


def mode_counts(found: DataFrame, top: int = 5) -> DataFrame:
    """Most frequent failure modes and their families, ties by name."""
    by = found.groupBy("mode_id").agg(F.count("*").alias("n"))
    return by.withColumn("family", F.substring_index("mode_id", ".", 1)).orderBy(F.desc("n"), "mode_id").limit(top)


def failure_stages(summary: DataFrame) -> DataFrame:
    share = F.col("first_pos") / F.greatest(F.lit(1), F.col("n_events"))
    stage = F.when(F.col("first_pos").isNull(), "none").when(share <= 0.33, "early").when(share <= 0.66, "middle").otherwise("late")
    return summary.groupBy(stage.alias("stage")).agg(F.count("*").alias("n"))


def step_histogram(summary: DataFrame) -> DataFrame:
    n = F.col("first_pos")
    bucket = F.when(n <= 5, "1-5").when(n <= 15, "6-15").when(n <= 30, "16-30").otherwise("31+")
    return summary.where("first_pos is not null").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def step_distribution(summary: DataFrame) -> DataFrame:
    """Runs per first position, every step up to the largest listed."""
    by = summary.where("first_pos >= 1").groupBy(F.col("first_pos").alias("step")).agg(F.count("*").alias("n"))
    steps = by.agg(F.max("step").alias("m")).where("m is not null").select(F.explode(F.sequence(F.lit(1), F.col("m"))).alias("step"))
    return steps.join(by, "step", "left").select("step", F.coalesce("n", F.lit(0)).alias("n"))


def priorities(summary: DataFrame) -> DataFrame:
    """10 a finding, up to 20 for an early first step (step 0 counts as unknown), 5 for a known root."""
    first = F.coalesce(F.expr("nullif(first_pos, 0)").cast("long"), F.col("n_events"))
    score = F.col("n_findings") * 10 + F.greatest(F.lit(0), 20 - first) + 5
    return summary.where("n_findings > 0").select("trace_id", score.alias("score"))


def timeline(runs: DataFrame, points: int = 48, roots: DataFrame | None = None) -> DataFrame:
    """Every (n div points)-th event of a run and the last one, with its state; ``roots(trace_id, event_id)`` are the runs' root causes."""
    w = Window.partitionBy("trace_id")
    n = F.count("*").over(w)
    rows = runs.select("trace_id", "event_id", "pos", "error", n.alias("n"))
    root = F.lit(False)
    if roots is not None:
        rows = rows.join(roots.select("trace_id", F.col("event_id").alias("root_id")), "trace_id", "left")
        root = F.col("event_id") == F.col("root_id")
    every = F.greatest(F.lit(1), F.expr(f"n div {points}"))
    return rows.where((F.col("pos") % every == 0) | (F.col("pos") == F.col("n") - 1)).select("trace_id", "event_id", "pos", F.when(root, "root").when(F.col("error").isNotNull(), "error").otherwise("ok").alias("state"))
