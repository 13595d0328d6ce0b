"""Rules and predicates over single events, with run-level gates; metadata is a VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .detect import KEYWORD_RULES

# They have to be these for the findings to be the same.
FAILED_STATUS = ("failed", "failure", "error")
NO_OP = "nothing happens"
NO_PROGRESS = ("no results", "not available", "not found")
BENCHMARK_MARKERS = ("alfworld", "webshop")
PROBLEM_WORDS = ("missing context", "premature", "loop", "handoff", "failure", "error")
LIFECYCLE = ("run.start", "run.end")
PAIR_TYPES = ("llm.response", "agent.step")
PACKS = ("core", "benchmark")


def field(name: str, kind: str = "string") -> Column:
    return F.expr(f"try_variant_get(metadata, '$.{name}', '{kind}')")


def prefix(runs: DataFrame, n: int) -> DataFrame:
    """The first n events of each run."""
    return runs.where(F.col("pos") < max(0, n))


def position_range(runs: DataFrame, start: int, end: int, limit: int = 200) -> DataFrame:
    """Events from start to end, both included; more than ``limit`` of them, or a start beyond the end, is an error."""
    if not 0 <= start <= end or end - start + 1 > limit:
        raise ValueError(f"a range of 1 to {limit} events is needed, not {start}..{end}")
    return runs.where(F.col("pos").between(start, end))


def event_text(text: str = "text") -> Column:
    """Type, text, error and metadata (canonical JSON), a line each; what is null is left out."""
    return F.concat_ws("\n", "event_type", text, "error", F.to_json("metadata"))


def structured_constraint() -> Column:
    """What a decision's metadata says was lost, else null."""
    said = F.trim(F.coalesce(field("decision_error"), F.lit("")))
    lost = F.coalesce(F.nullif(field("dropped_constraint"), F.lit("")), F.nullif(field("violated_constraint"), F.lit("")))
    return F.when(said != "", said).when(lost.isNotNull(), F.concat(F.lit("constraint '"), lost, F.lit("' was not preserved")))


def failed_status() -> Column:
    return F.coalesce(F.lower(field("status")).isin(*FAILED_STATUS), F.lit(False))


def packs_of(spec: str) -> Column:
    """Rule packs of a run: ``auto`` adds the benchmark pack where the framework names one."""
    bench = F.lower("framework").rlike("|".join(BENCHMARK_MARKERS))
    if spec == "auto":
        return F.when(bench, F.array(*map(F.lit, PACKS))).otherwise(F.array(F.lit("core")))
    if spec == "all":
        return F.array(*map(F.lit, PACKS))
    if spec not in PACKS:
        raise ValueError(f"unknown rule pack {spec!r}")
    return F.array(F.lit(spec))


def first_match(runs: DataFrame, spec: str = "auto") -> DataFrame:
    """At most one finding per event: the first rule by priority, then by load order, of the run's packs.

    The rules' conditions stand in one COALESCE in that order, so nothing is joined; the searched text
    is built once, behind a generator that keeps it from being copied into every condition.
    """
    rows = runs.withColumn("packs", packs_of(spec)).withColumn("low", F.explode(F.array(F.lower(event_text()))))
    has = lambda words: F.reduce(F.array(*[F.contains("low", F.lit(w)) for w in words]), F.lit(False), lambda a, b: a | b)
    core, bench = (F.array_contains("packs", p) for p in PACKS)
    low_frame = F.lower("framework")
    hit = lambda rule, mode, priority, confidence=None: F.struct(F.lit(rule).alias("rule_id"), F.lit(mode).alias("mode_id") if isinstance(mode, str) else mode.alias("mode_id"), F.lit(priority).alias("priority"), F.lit(confidence).cast("double").alias("confidence"))
    tool = F.when(F.col("event_type").isin("tool.call", "tool.result"), "system.tool_execution_error").otherwise("system.environment_error")
    rules = [
        F.when(core & structured_constraint().isNotNull(), hit("core.planning.constraint_ignorance.structured", "planning.constraint_ignorance", 50, 0.95)),
        F.when(bench & F.contains("low", F.lit(NO_OP)) & F.contains(low_frame, F.lit("alfworld")), hit("benchmark.alfworld.no_op", "planning.inefficient_plan", 50)),
        F.when(bench & has(NO_PROGRESS) & F.contains(low_frame, F.lit("webshop")), hit("benchmark.webshop.no_progress", "planning.inefficient_plan", 60)),
        F.when(core & (F.coalesce("error", F.lit("")) != ""), hit("core.explicit_error", tool, 100)),
        *[F.when(core & has(needles), hit(rule, mode, priority)) for rule, mode, needles, priority in sorted(KEYWORD_RULES, key=lambda r: r[3])],
        F.when(core & failed_status(), hit("core.system.environment_error.metadata_status", "system.environment_error", 1000)),
    ]
    return rows.select("trace_id", "event_id", "pos", "step_index", "agent_name", F.coalesce(*rules).alias("hit")).where("hit is not null").select("trace_id", "event_id", "pos", "step_index", "agent_name", "hit.*")


def attributable(runs: DataFrame, semantics: Column) -> DataFrame:
    """Events that can be blamed: none of the run's start and end; with paired turns, the agent's only."""
    pairs = semantics.isin("env_agent_pairs", "paired_turns", "assistant_only", "assistant_steps", "assistant_turns")
    return runs.where(F.when(pairs, F.col("event_type").isin(*PAIR_TYPES)).otherwise(~F.col("event_type").isin(*LIFECYCLE)))


def judgable(runs: DataFrame, types: tuple[str, ...] = ("agent.step", "plan", "tool.call", "reflection", "llm.response")) -> DataFrame:
    return runs.where(F.col("event_type").isin(*types))


def capture_excluded(runs: DataFrame) -> DataFrame:
    """Events that a capture leaves out, with the reason; results whose parent (the call before them) is left out go with it."""
    reason = F.when(F.col("event_type") == "reflection", "private_reasoning").when(F.coalesce(field("capture_owned", "boolean"), F.lit(False)), "integration_owned")
    w = Window.partitionBy("trace_id").orderBy("pos")
    rows = runs.withColumn("reason", reason)
    before = F.lag(F.struct("event_type", "reason")).over(w)
    orphan = (F.col("event_type") == "tool.result") & (before["event_type"] == "tool.call") & before["reason"].isNotNull()
    return rows.withColumn("reason", F.coalesce("reason", F.when(orphan, "parent_excluded"))).where("reason is not null").select("trace_id", "event_id", "pos", "reason")


def has_problem() -> Column:
    """An error, or a word of trouble in the event's text."""
    low = F.lower(F.concat_ws(" ", "event_type", "text"))
    return (F.coalesce("error", F.lit("")) != "") | low.rlike("|".join(PROBLEM_WORDS))


def run_failed(runs: DataFrame) -> DataFrame:
    """Per run: a metadata success that is false, or an error event of the agent ``system``."""
    bad = (~field("success", "boolean")) | ((F.col("event_type") == "error") & (F.col("agent_name") == "system"))
    return runs.groupBy("trace_id").agg(F.coalesce(F.bool_or(bad), F.lit(False)).alias("failed"))
