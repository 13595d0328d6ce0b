"""Texts made from findings: retry hints, verifiers, rules, manifests, actor tasks, references, spans for export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.trace import clamp, compact

NO_ADVICE = "Inspect the offending step and constrain the agent at that point."
NO_FIX = "Re-attempt the step with the diagnosed mistake corrected."


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("None"))


def _evidence() -> Column:
    return F.when(F.size("evidence") > 0, F.array_join(F.transform("evidence", lambda e: F.concat(F.lit("  - "), e)), "\n")).otherwise("  (none)")


def retry_hints(findings: DataFrame) -> DataFrame:
    """A reflection per finding: what was to be done, what went wrong and where, and what to do next time."""
    advice = F.coalesce("suggestion", F.get("templates", F.lit(0)), F.lit(NO_ADVICE))
    text = F.concat(
        F.lit("Task: "), F.coalesce("goal", F.lit("(no goal recorded)")), F.lit("\nFramework: "), F.coalesce("framework", F.lit("(framework not declared)")), F.lit("\nObserved failure mode: "), _text("mode_id"), F.lit(" ("), _text("mode_name"), F.lit(")\nLocated at agent="), _text("agent_name"),
        F.lit(", step="), _text("step_index"), F.lit(", event_id="), _text("event_id"), F.lit("\nEvidence:\n"), _evidence(), F.lit("\nNext time, do the following:\n  "), advice, F.lit("\n"),
    )
    return findings.select("finding_id", text.alias("text"), clamp(F.col("confidence"), 0.1, 0.9).alias("confidence"))


def root_directive(findings: DataFrame) -> DataFrame:
    """One directive per run, from the finding at the root's step, else its first."""
    at_root = F.coalesce(F.col("step_index") == F.col("root_step"), F.lit(False))
    first = findings.withColumn("r", F.row_number().over(Window.partitionBy("trace_id").orderBy(F.desc(at_root), "ordinal"))).where("r = 1")
    text = F.concat(F.lit("Task: "), F.coalesce("goal", F.lit("(no goal recorded)")), F.lit("\nRoot cause: step "), _text("step_index"), F.lit(", agent "), _text("agent_name"), F.lit("\nEvidence:\n"), _evidence(), F.lit("\nFix for the retry:\n  "), F.coalesce("suggestion", F.lit(NO_FIX)), F.lit("\n"))
    return first.select("trace_id", "finding_id", text.alias("text"), clamp(F.col("confidence"), 0.2, 0.95).alias("confidence"))


def verifier_advice(served: DataFrame) -> DataFrame:
    """``(finding, verifier)`` rows to what to add and where."""
    summary = F.concat(F.lit("Add "), "verifier", F.lit(" before "), "mode_id", F.lit(" (step "), _text("step_index"), F.lit(", agent "), _text("agent_name"), F.lit(")"))
    return served.select("finding_id", "verifier", summary.alias("summary"), clamp(F.col("confidence"), 0.3, 0.85).alias("confidence"))


def manual_rules(findings: DataFrame, manual: str) -> DataFrame:
    """One-line rules that the manual doesn't hold yet, whatever the case; a finding without advice gives none."""
    rule = F.trim(F.coalesce("suggestion", F.get("templates", F.lit(0))))
    return findings.withColumn("rule", rule).where("rule is not null").where(~F.contains(F.lit(manual.lower()), F.lower("rule"))).select("finding_id", "rule", clamp(F.col("confidence"), 0.4, 0.9).alias("confidence"))


def distinct_suggestions(findings: DataFrame) -> DataFrame:
    """A run's suggestions in order, each once."""
    by = findings.where("suggestion is not null").groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "suggestion"))).alias("s"))
    return by.select("trace_id", F.array_distinct(F.transform("s", lambda x: x["suggestion"])).alias("suggestions"))


def report_modes(findings: DataFrame) -> DataFrame:
    """A run's failure modes and families, each once, in order."""
    by = findings.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "mode_id"))).alias("s"))
    modes = F.transform("s", lambda x: x["mode_id"])
    return by.select("trace_id", F.array_distinct(modes).alias("modes"), F.array_distinct(F.transform(modes, lambda m: F.substring_index(m, ".", 1))).alias("families"))


def manifest(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """What a bundle says of a run: counts, failure modes, a goal cut to 200 characters."""
    by = runs.groupBy("trace_id").agg(F.count("*").alias("n_events"), F.count_distinct("agent_name").alias("n_agents"), F.first("framework").alias("framework"))
    some = findings.groupBy("trace_id").agg(F.count("*").alias("n_findings"))
    goal = compact(F.concat(F.lit("solve "), "trace_id"), 200)
    return by.join(some, "trace_id", "left").select("trace_id", "framework", goal.alias("goal"), "n_events", "n_agents", F.coalesce("n_findings", F.lit(0)).alias("n_findings"))


def otel_spans(runs: DataFrame) -> DataFrame:
    """Spans to export: one for the run and one per event below it."""
    root = runs.groupBy("trace_id").agg(F.sum("duration_ms").alias("duration_ms")).select("trace_id", F.concat("trace_id", F.lit(":root")).alias("span_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("agent.run").alias("name"), F.lit("OK").alias("status"), F.round("duration_ms", 6).alias("duration_ms"))
    event = runs.select("trace_id", F.col("event_id").alias("span_id"), F.concat("trace_id", F.lit(":root")).alias("parent_id"), F.col("event_type").alias("name"), F.when(F.coalesce("error", F.lit("")) != "", "ERROR").otherwise("OK").alias("status"), F.round("duration_ms", 6).alias("duration_ms"))
    return root.unionByName(event)


def actor_tasks(targets: DataFrame) -> DataFrame:
    """Flat rows that an actor can rerun from, nested parts as JSON text."""
    return targets.select(F.concat(F.lit("task-"), "finding_id").alias("task_id"), "trace_id", "event_id", F.to_json(F.struct("step_index", "agent_name")).alias("target"), F.to_json(F.struct(F.col("mode_id"), F.coalesce("suggestion", F.lit(NO_FIX)).alias("fix"))).alias("directive"))


def reference_block(runs: DataFrame, n: int = 300) -> DataFrame:
    """A passing run as text, a line per event."""
    line = F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("] "), "agent_name", F.lit(": "), F.substring(F.coalesce("text", F.lit("")), 1, n))
    by = runs.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("s"))
    return by.select("trace_id", F.array_join(F.transform("s", lambda x: x["line"]), "\n").alias("block"))


def trajectory_text(runs: DataFrame, first: int = 80) -> DataFrame:
    """The first events of each run as one line of text each."""
    line = F.concat(F.lit("Step "), _text("step_index"), F.lit(" - "), "agent_name", F.lit(": output="), F.coalesce("text", F.lit("")), F.lit(" error="), F.coalesce("error", F.lit("")))
    by = runs.where(F.col("pos") < first).groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("s"))
    return by.select("trace_id", F.array_join(F.transform("s", lambda x: x["line"]), "\n").alias("text"))


def root_summary(reports: DataFrame) -> DataFrame:
    """The root's event and step, else the first finding's; a root at step 0 falls through to it."""
    step = F.coalesce(F.nullif(F.col("root_step"), F.lit(0)), "first_step")
    return reports.select("trace_id", F.coalesce("root_event", "first_event").alias("event_id"), step.alias("step_index"))
