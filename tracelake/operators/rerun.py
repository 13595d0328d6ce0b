"""Requests to run a failed run again: where from, with what directive, and whether that can be done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is said where no suggestion is there, executors' modes, and what a rerun needs.
NO_DIRECTIVE = "Retry from the diagnosed root-cause step. Inspect the evidence in the diagnostic report before execution."
LIVE, SIMULATED = "live_execution", "simulated_rollout"
NEEDS = ("framework_runner", "tool_runtime", "environment_state")
REPLAYED = ("environment_snapshot", "tool_manifest", "dependency_lock")


def _checkpoints(reports: DataFrame, runs: DataFrame, findings: DataFrame) -> DataFrame:
    """Each report's event: its root's, else the first of its root step, else that of the first finding whose event is in the run."""
    here = runs.groupBy("trace_id", "event_id").agg(F.min_by("step_index", "pos").alias("at"))
    by_step = runs.where("step_index is not null").groupBy("trace_id", "step_index").agg(F.min_by("event_id", "pos").alias("of_step"))
    found = findings.where("event_id is not null").join(here, ["trace_id", "event_id"]).groupBy("trace_id").agg(F.min_by(F.struct("event_id", "at"), "ordinal").alias("of_finding"))
    rows = reports.join(here.select("trace_id", F.col("event_id").alias("root_event_id"), F.col("at").alias("root_at"), F.lit(True).alias("there")), ["trace_id", "root_event_id"], "left")
    rows = rows.join(by_step.withColumnRenamed("step_index", "root_step_index"), ["trace_id", "root_step_index"], "left").join(found, "trace_id", "left")
    target = (
        F.when(F.col("there"), F.struct(F.col("root_event_id").alias("event_id"), F.col("root_at").alias("at")))
        .when(F.col("of_step").isNotNull(), F.struct(F.col("of_step").alias("event_id"), F.col("root_step_index").alias("at")))
        .when(F.col("of_finding").isNotNull(), F.col("of_finding"))
        .otherwise(F.struct(F.col("root_event_id").alias("event_id"), F.col("root_step_index").alias("at")))
    )
    return rows.withColumn("target", target).drop("there", "root_at", "of_step", "of_finding")


def requests(reports: DataFrame, runs: DataFrame, findings: DataFrame, chosen: DataFrame | None = None, from_start: bool = False) -> DataFrame:
    """``trace_id, report_id, event_id, step_index, policy, directive, target_event_id, needs_approval, n_findings, n_suggestions, error``, a row per report.

    ``reports(trace_id, report_id, root_event_id, root_step_index, recovery, suggestions)`` with recovery as
    VARIANT; ``findings(trace_id, ordinal, event_id, suggestion)``. From the start there is no checkpoint, and
    the directive keeps the root's event. ``chosen(trace_id, event_id)`` names checkpoints; one that its run doesn't
    have is an error of its row, and of several for a run the least counts. The directive is the first proposal's
    text, else the report's first suggestion, else the first finding's, else a fixed one. Approval is needed unless
    the first proposal says otherwise. A run that isn't there leaves the report's own root.
    """
    rows = _checkpoints(reports, runs, findings)
    error = F.lit(None).cast("string")
    event, step = F.col("target.event_id"), F.col("target.at")
    if from_start:
        event, step = F.lit(None).cast("string"), F.lit(None).cast(rows.schema["root_step_index"].dataType)
    elif chosen is not None:
        named = chosen.groupBy("trace_id").agg(F.min("event_id").alias("named"))
        here = runs.groupBy("trace_id", F.col("event_id").alias("named")).agg(F.min_by("step_index", "pos").alias("named_at"), F.lit(True).alias("known"))
        rows = rows.join(named, "trace_id", "left").join(here, ["trace_id", "named"], "left")
        has_run = rows.join(runs.select("trace_id").distinct().withColumn("ran", F.lit(True)), "trace_id", "left")
        rows, asked = has_run, F.col("named").isNotNull() & F.col("ran")
        event, step = F.when(asked, F.col("named")).otherwise(event), F.when(asked, F.col("named_at")).otherwise(step)
        error = F.when(asked & F.col("known").isNull(), F.concat(F.lit("unknown checkpoint event: "), "named"))
    by = findings.groupBy("trace_id").agg(F.min_by(F.nullif("suggestion", F.lit("")), F.when(F.col("suggestion") != "", F.col("ordinal"))).alias("found_text"), F.count("*").alias("n"))
    rows = rows.join(by, "trace_id", "left")
    first = F.get(F.try_variant_get("recovery", "$.proposals", "array<variant>"), F.lit(0))
    proposed = F.nullif(F.try_variant_get(first, "$.suggestion_text", "string"), F.lit(""))
    directive = F.coalesce(proposed, F.get("suggestions", F.lit(0)), "found_text", F.lit(NO_DIRECTIVE))
    return rows.select(
        "trace_id", "report_id", event.alias("event_id"), step.alias("step_index"), F.lit("from_start" if from_start else "from_root_cause").alias("policy"), directive.alias("directive"), (F.col("root_event_id") if from_start else event).alias("target_event_id"),
        F.coalesce(F.try_variant_get(first, "$.requires_human_approval", "boolean"), F.lit(True)).alias("needs_approval"), F.coalesce("n", F.lit(0)).cast("long").alias("n_findings"), F.greatest(F.size("suggestions"), F.lit(0)).cast("long").alias("n_suggestions"), error.alias("error"),
    )


def capability(metadata: Column, mode: Column, allow_simulated: bool = False) -> Column:
    """``level, executable, missing, available`` from a run's metadata (VARIANT; null for a report without its run) and its executor's mode (null without one)."""
    replay = F.try_variant_get(metadata, "$.replay_bundle", "variant")
    held = F.coalesce(F.schema_of_variant(replay).startswith("OBJECT"), F.lit(False))
    part = lambda k: held & F.coalesce(~F.to_json(F.try_variant_get(replay, f"$.{k}", "variant")).isin("null", "false", "0", '""', "[]", "{}"), F.lit(False))
    lists = lambda *xs: F.array_compact(F.array(*[F.when(when, F.lit(x)) for x, when in xs]))
    available = lists(("diagnostic_report", F.lit(True)), ("trajectory", metadata.isNotNull()), ("replay_bundle", held), *[(k, part(k)) for k in REPLAYED])
    live = F.coalesce(mode == LIVE, F.lit(False))
    simulated = F.coalesce(mode == SIMULATED, F.lit(False)) & F.lit(allow_simulated)
    every = F.array(*map(F.lit, NEEDS))
    lacking = lists((NEEDS[0], F.lit(True)), (NEEDS[1], ~part("tool_manifest")), (NEEDS[2], ~part("environment_snapshot")))
    return F.struct(
        F.when(live, "live_runner").when(~simulated & held, "replay_bundle").otherwise("trajectory_only").alias("level"), (live | simulated).alias("executable"), F.when(live, F.array().cast("array<string>")).when(simulated, every).otherwise(lacking).alias("missing"),
        F.when(live, F.concat(available, F.array(F.lit("framework_runner"), F.lit("tool_runtime")))).otherwise(available).alias("available"),
    )
