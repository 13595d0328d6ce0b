"""Failure detection: event rules, sequence rules, first match, root selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squeeze

# Rule id, failure mode, needles, priority. They have to be these for the findings to be the same.
KEYWORD_RULES = (
    ("core.system.llm_limit", "system.llm_limit", ("context length", "rate limit", "token limit"), 200),
    ("core.action.format_error", "action.format_error", ("json", "schema", "malformed", "parse error"), 300),
    ("core.action.parameter_error", "action.parameter_error", ("missing parameter", "invalid parameter", "hallucinated argument"), 310),
    ("core.action.wrong_tool", "action.wrong_tool", ("unknown tool", "wrong tool", "tool mismatch"), 320),
    ("core.planning.inefficient_plan", "planning.inefficient_plan", ("loop", "repeated", "no progress", "max steps"), 400),
    ("core.planning.constraint_ignorance", "planning.constraint_ignorance", ("policy violation", "constraint ignored", "must not"), 410),
    ("core.verification.premature_stop", "verification.premature_stop", ("premature", "early termination", "not complete"), 500),
    ("core.multiagent.handoff_loss", "multiagent.handoff_loss", ("handoff", "lost context", "missing context"), 600),
    ("core.multimodal.perception_error", "multimodal.perception_error", ("ocr error", "visual mismatch", "ui element mismatch", "perception error"), 700),
)
STATE_TYPES = ("observation", "agent.step", "plan", "tool.result")
# Phrases that claim success; the first of them in a text is the one reported.
CLAIMS = (
    "task is complete", "task complete", "task is done", "task accomplished", "completed the task", "i have completed", "i am done", "we are done",
    "all done", "successfully completed", "no further action", "nothing left to do", "marking as complete", "is complete", "final answer",
)
CLAIM_TYPES = ("reflection", "observation", "llm.response", "agent.step", "plan")


def keyword_first_match(rows: DataFrame, key: str, text: str, rules=KEYWORD_RULES) -> DataFrame:
    """At most one finding per row: the rule of least priority one of whose needles is in the lower-cased text.

    One CASE in priority order: it stops at the first hit, and nothing is joined or shuffled. A generator
    keeps the optimiser from copying the lower-casing and the CASE into the filter again.
    """
    low = F.col("low")
    hit = F.lit(None).cast("struct<rule_id:string,mode_id:string,priority:int>")
    for rule_id, mode, needles, priority in sorted(rules, key=lambda r: r[3], reverse=True):
        found = F.lit(False)
        for n in needles:
            found = found | F.contains(low, F.lit(n))
        hit = F.when(found, F.struct(F.lit(rule_id).alias("rule_id"), F.lit(mode).alias("mode_id"), F.lit(priority).alias("priority"))).otherwise(hit)
    rows = rows.select(key, F.explode(F.array(F.lower(F.col(text)))).alias("low"))
    return rows.select(key, F.inline(F.array_compact(F.array(hit))))


def explicit_errors(runs: DataFrame) -> DataFrame:
    """A finding per event with an error text; tool events and others differ in mode."""
    mode = F.when(F.col("event_type").isin("tool.call", "tool.result"), "system.tool_execution_error").otherwise("system.environment_error")
    return runs.where("error is not null and error <> ''").select("trace_id", "event_id", "pos", "agent_name", mode.alias("mode_id"))


def failed_runs(runs: DataFrame) -> DataFrame:
    """Per run, whether an event says success = false."""
    return runs.groupBy("trace_id").agg(F.coalesce(F.bool_or(~F.col("success")), F.lit(False)).alias("failed"), F.count("*").alias("n_events"))


def repeated_tool_calls(runs: DataFrame, threshold: int = 3) -> DataFrame:
    """Equal calls of one agent in a run, ``threshold`` times or more; the finding is on the last."""
    calls = runs.where("event_type = 'tool.call'").withColumn("signature", squeeze(F.col("payload")))
    by = calls.groupBy("trace_id", "agent_name", "signature").agg(F.count("*").alias("n"), F.max(F.struct("pos", "event_id")).alias("last"), F.min("pos").alias("first_pos"))
    return by.where(F.col("n") >= threshold).select("trace_id", "agent_name", "signature", "n", F.col("last.event_id").alias("event_id"), F.col("last.pos").alias("pos"), "first_pos")


def step_budget(runs: DataFrame, limit: int = 50) -> DataFrame:
    """Runs of more than ``limit`` events; the finding is on the last."""
    by = runs.groupBy("trace_id").agg(F.count("*").alias("n"), F.max(F.struct("pos", "event_id")).alias("last"))
    return by.where(F.col("n") > limit).select("trace_id", "n", F.col("last.event_id").alias("event_id"), F.col("last.pos").alias("pos"))


def state_signature(runs: DataFrame) -> DataFrame:
    cut = lambda c: F.substring(squeeze(F.col(c)), 1, 200)
    return runs.withColumn("signature", F.concat_ws("|", "event_type", "agent_name", cut("payload"), cut("error")))


def repeated_states(runs: DataFrame, window: int = 4, threshold: int = 3) -> DataFrame:
    """Sliding windows of state-bearing events in which one signature occurs ``threshold`` times or more."""
    states = state_signature(runs.where(F.col("event_type").isin(*STATE_TYPES)))
    w = Window.partitionBy("trace_id").orderBy("pos").rowsBetween(1 - window, 0)
    held = states.select("trace_id", "event_id", "pos", F.collect_list("signature").over(w).alias("held"))
    most = F.array_max(F.transform("held", lambda s: F.size(F.filter("held", lambda x: x == s))))
    return held.where(F.size("held") == window).withColumn("most", most).where(F.col("most") >= threshold).select("trace_id", "event_id", "pos", "most")


def premature_success(runs: DataFrame, claims: tuple[str, ...] = CLAIMS, text: str = "payload") -> DataFrame:
    """Failed runs' last event of a claiming type whose text holds a claim; the claim is the first of the list in it.

    A run failed if an event says success = false, or if it has an error event of the agent ``system``.
    """
    low = F.lower(F.concat_ws("\n", F.col(text), "error"))
    w = Window.partitionBy("trace_id")
    marked = runs.withColumn("failed", F.coalesce(F.bool_or(~F.col("success") | ((F.col("event_type") == "error") & (F.col("agent_name") == "system"))).over(w), F.lit(False))).where(F.col("failed") & F.col("event_type").isin(*CLAIM_TYPES))
    hit = marked.withColumn("claim", F.try_element_at(F.filter(F.array(*map(F.lit, claims)), lambda c: F.contains(low, c)), F.lit(1))).where("claim is not null")
    by = hit.groupBy("trace_id").agg(F.max(F.struct("pos", "event_id", "claim")).alias("last"))
    return by.select("trace_id", F.col("last.event_id").alias("event_id"), F.col("last.pos").alias("pos"), F.col("last.claim").alias("claim"))


def findings(runs: DataFrame, limit: int = 65) -> DataFrame:
    """All findings with their order in a run: event findings first by position, then those of sequence rules.

    One pass: the rules' counts are windows over the run's own partition, and each event gives the findings it carries.
    """
    run, call = Window.partitionBy("trace_id"), Window.partitionBy("trace_id", "agent_name", "signature")
    rows = runs.withColumn("signature", F.when(F.col("event_type") == "tool.call", squeeze(F.col("payload"))))
    rows = rows.select("trace_id", "event_id", "pos", "event_type", "error", "signature", F.count("*").over(run).alias("n"), F.max("pos").over(run).alias("last"), F.count("*").over(call).alias("same"), F.max("pos").over(call).alias("last_same"))
    mode = F.when(F.col("event_type").isin("tool.call", "tool.result"), "system.tool_execution_error").otherwise("system.environment_error")
    finding = lambda mode, phase, confidence: F.struct(mode.alias("mode_id"), F.lit(phase).alias("phase"), confidence.cast("double").alias("confidence"))
    slow = F.lit("planning.inefficient_plan")
    found = F.array(
        F.when(F.col("error") != "", finding(mode, 0, F.lit(0.5) + (F.col("pos") % 10) / F.lit(100.0))),
        F.when(F.col("signature").isNotNull() & (F.col("same") >= 3) & (F.col("pos") == F.col("last_same")), finding(slow, 1, F.lit(0.7))),
        F.when((F.col("n") > limit) & (F.col("pos") == F.col("last")), finding(slow, 2, F.lit(0.6))),
    )
    return rows.select("trace_id", "event_id", "pos", F.inline(F.array_compact(found)))


def select_root(found: DataFrame, policy: str = "earliest") -> DataFrame:
    """One finding per run: ``earliest`` (step, then confidence) or ``confident`` (confidence, then step); ties by order."""
    order = [F.col("pos").isNull(), F.col("pos"), F.desc("confidence")] if policy == "earliest" else [F.desc("confidence"), F.col("pos").isNull(), F.col("pos")]
    w = Window.partitionBy("trace_id").orderBy(*order, "phase", "event_id", "mode_id")
    return found.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
