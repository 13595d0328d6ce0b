"""From a blamed step to an event: resolution, anchoring, clustering and ranking of findings.

A blame is ``(trace_id, blame_id, span_id, step, agent)``, each of the last three possibly null. Events
are reduced to one row per key before they are joined, so no join makes more rows than blames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squeeze

KEY = ["trace_id", "blame_id"]


def canon(agent: Column) -> Column:
    """Agent name without a bracketed part, trimmed and lower-cased."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(agent, F.lit("")), r"(?s)\s*\(.*$", "")))


def _event() -> Column:
    return F.struct("event_id", "step_index", "agent_name")


def _candidates(blames: DataFrame, runs: DataFrame, agent: Column) -> DataFrame:
    """Blames with the event of their span, the first and the only event of their step, and of their step and agent."""
    events = runs.select("trace_id", "event_id", "step_index", "agent_name", "pos", agent.alias("named"))
    by_id = events.select("trace_id", F.col("event_id").alias("span_id"), _event().alias("of_id"))
    first = F.min_by(_event(), F.col("pos"))
    by_step = events.where("step_index is not null").groupBy("trace_id", F.col("step_index").alias("step")).agg(first.alias("of_step"), F.count("*").alias("n_step"))
    by_agent = events.where("step_index is not null").groupBy("trace_id", F.col("step_index").alias("step"), "named").agg(first.alias("of_agent"), F.count("*").alias("n_agent"))
    return blames.join(by_id, ["trace_id", "span_id"], "left").join(by_step, ["trace_id", "step"], "left").join(by_agent, ["trace_id", "step", "named"], "left")


def _resolved(rows: DataFrame, event: Column) -> DataFrame:
    return rows.select(*KEY, event["event_id"].alias("event_id"), event["step_index"].alias("step_index"), event["agent_name"].alias("agent_name"))


def blamed_event(blames: DataFrame, runs: DataFrame) -> DataFrame:
    """The event of the span, else the first of the step."""
    rows = _candidates(blames.withColumn("named", F.col("agent")), runs, F.col("agent_name"))
    return _resolved(rows, F.coalesce("of_id", "of_step"))


def resolve_candidate(blames: DataFrame, runs: DataFrame) -> DataFrame:
    """The span's event if step and agent agree with it; else the step's only event of the agent; else the step's only event."""
    rows = _candidates(blames.withColumn("named", canon(F.col("agent"))), runs, canon(F.col("agent_name")))
    stated = F.coalesce("agent", F.lit("")) != ""
    agrees = (F.col("step").isNull() | (F.col("of_id.step_index") == F.col("step"))) & (~stated | (canon(F.col("of_id.agent_name")) == F.col("named")))
    return _resolved(rows, F.coalesce(F.when(agrees, F.col("of_id")), F.when(stated & (F.col("n_agent") == 1), F.col("of_agent")), F.when(F.col("n_step") == 1, F.col("of_step"))))


def attributed_event(blames: DataFrame, runs: DataFrame) -> DataFrame:
    """The span's event, else the only event of step and agent (of the step, where no agent is named)."""
    rows = _candidates(blames.withColumn("named", F.trim("agent")), runs, F.col("agent_name"))
    unnamed = F.coalesce("named", F.lit("")) == ""
    return _resolved(rows, F.coalesce("of_id", F.when(unnamed & (F.col("n_step") == 1), F.col("of_step")), F.when(F.col("n_agent") == 1, F.col("of_agent"))))


def normalize(blames: DataFrame, runs: DataFrame) -> DataFrame:
    """The span's event; else of the step, that of the agent first; else the step read as an ordinal among attributable events."""
    rows = _candidates(blames.withColumn("named", F.col("agent")), runs, F.col("agent_name"))
    pool = runs.where(~F.col("event_type").isin("run.start", "run.end"))
    ordinal = pool.select("trace_id", (F.row_number().over(Window.partitionBy("trace_id").orderBy("pos")) - 1).alias("step"), _event().alias("of_ordinal"))
    return _resolved(rows.join(ordinal, ["trace_id", "step"], "left"), F.coalesce("of_id", "of_agent", "of_step", "of_ordinal"))


def prefer_finding(blames: DataFrame, found: DataFrame) -> DataFrame:
    """Blames re-pointed to the detector's event where exactly one finding of their step fits their agent: ``..., span_id, anchored``."""
    some = found.where("event_id is not null and step_index is not null").select("trace_id", F.col("step_index").alias("step"), F.col("event_id").alias("found_id"), F.col("agent_name").alias("found_agent"))
    by_agent = some.groupBy("trace_id", "step", "found_agent").agg(F.count("*").alias("n"), F.min("found_id").alias("found_id"))
    by_step = by_agent.groupBy("trace_id", "step").agg(F.sum("n").alias("n_all"), F.min("found_id").alias("any_id"), F.sum(F.when(F.col("found_agent").isNull(), F.col("n")).otherwise(0)).alias("n_unnamed"), F.min(F.when(F.col("found_agent").isNull(), F.col("found_id"))).alias("unnamed_id"))
    rows = blames.join(by_step, ["trace_id", "step"], "left").join(by_agent.withColumnRenamed("found_agent", "agent"), ["trace_id", "step", "agent"], "left")
    fits = F.when(F.col("agent").isNull(), F.col("n_all")).otherwise(F.coalesce("n", F.lit(0)) + F.coalesce("n_unnamed", F.lit(0)))
    target = F.when(F.col("agent").isNull(), F.col("any_id")).otherwise(F.coalesce("found_id", "unnamed_id"))
    moved = (fits == 1) & ~F.col("span_id").eqNullSafe(target)
    return rows.select(*KEY, F.when(moved, target).otherwise(F.col("span_id")).alias("span_id"), F.coalesce(moved, F.lit(False)).alias("anchored"))


def recovery_target(blames: DataFrame, found: DataFrame) -> DataFrame:
    """The finding that recovery works from: of the event, else of step and a fitting agent, else the run's first; null without findings."""
    f = found.select("trace_id", "finding_id", F.col("event_id").alias("f_event"), F.col("step_index").alias("f_step"), F.col("agent_name").alias("f_agent"), "ordinal")
    first = f.groupBy("trace_id").agg(F.min_by("finding_id", "ordinal").alias("of_run"))
    by_event = f.groupBy("trace_id", F.col("f_event").alias("event_id")).agg(F.min_by("finding_id", "ordinal").alias("of_event"))
    by_agent = f.where("f_step is not null").groupBy("trace_id", F.col("f_step").alias("step_index"), F.col("f_agent").alias("agent_name")).agg(F.min_by("finding_id", "ordinal").alias("of_agent"))
    rows = blames.join(by_event, ["trace_id", "event_id"], "left").join(by_agent, ["trace_id", "step_index", "agent_name"], "left").join(first, "trace_id", "left")
    return rows.select("trace_id", "event_id", F.coalesce("of_event", "of_agent", "of_run").alias("finding_id"))


def cluster(found: DataFrame) -> DataFrame:
    """Findings of a run grouped by the text they contradict (squeezed, lower-cased); without such text each is its own instance.

    ``trace_id, instance, n, origin_id, first_step, last_step``: instances are numbered as they are first seen, the
    origin is the finding of least step, then of most confidence.
    """
    reference = F.lower(squeeze(F.col("reference_quote")))
    key = F.when(reference != "", reference).otherwise(F.concat(F.lit("\0"), "finding_id"))
    order = F.struct(F.col("step_index").isNull(), "step_index", -F.coalesce("confidence", F.lit(0.0)), "ordinal")
    by = found.groupBy("trace_id", key.alias("key")).agg(F.min("ordinal").alias("seen"), F.count("*").alias("n"), F.min_by("finding_id", order).alias("origin_id"), F.min("step_index").alias("first_step"), F.max("step_index").alias("last_step"), F.max(F.coalesce("confidence", F.lit(0.0))).alias("confidence"))
    return by.select("trace_id", (F.row_number().over(Window.partitionBy("trace_id").orderBy("seen")) - 1).alias("instance"), "n", "origin_id", "first_step", "last_step", "confidence")


def rank_instances(instances: DataFrame, policy: str = "earliest", ruled_out: Column | None = None) -> DataFrame:
    """Instances ruled out of the chain last, then by first step or by confidence."""
    out = F.lit(False) if ruled_out is None else F.coalesce(ruled_out, F.lit(False))
    step = [F.col("first_step").isNull(), F.col("first_step")]
    order = [*step, F.desc("confidence")] if policy == "earliest" else [F.desc("confidence"), *step]
    return instances.withColumn("rank", F.row_number().over(Window.partitionBy("trace_id").orderBy(out, *order, "instance")))


def proposal_order() -> list[Column]:
    """Steps first, least first, then the most confident, then the proposer's name."""
    return [F.col("step").isNull(), F.coalesce("step", F.lit(0)), -F.col("confidence"), F.col("proposer")]


def promote(proposals: DataFrame) -> DataFrame:
    """The proposal of most votes for its step (none for no step), then in proposal order; with votes and unanimity."""
    w = Window.partitionBy("trace_id")
    votes = F.when(F.col("step").isNotNull(), F.count("step").over(Window.partitionBy("trace_id", "step")))
    rows = proposals.withColumns({"votes": votes, "usable": F.count("*").over(w), "stepped": F.count("step").over(w), "least": F.min("step").over(w), "most": F.max("step").over(w)})
    rank = F.row_number().over(w.orderBy(-F.coalesce("votes", F.lit(-1)), *proposal_order()))
    unanimous = (F.col("usable") > 1) & (F.col("stepped") == F.col("usable")) & (F.col("least") == F.col("most"))
    return rows.withColumn("rank", rank).where("rank = 1").select("trace_id", "proposer", "step", F.coalesce("votes", F.lit(0)).alias("votes"), F.coalesce(unanimous, F.lit(False)).alias("unanimous"))


def score_gold(rows: DataFrame) -> DataFrame:
    """``(gold_agent, gold_step, agent, step)`` to agent match (one name in the other), exact and near step, and both; null without gold."""
    norm = lambda c: F.nullif(F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))), F.lit(""))
    g, p = norm("gold_agent"), norm("agent")
    match = F.coalesce(F.contains(p, g) | F.contains(g, p), F.lit(False))
    exact = F.coalesce(F.col("step") == F.col("gold_step"), F.lit(False))
    near = F.coalesce(F.abs(F.col("step") - F.col("gold_step")) <= 1, F.lit(False))
    known = g.isNotNull() | F.col("gold_step").isNotNull()
    flags = {"agent_match": match, "exact_step": exact, "near_step": near, "both_exact": match & exact, "both_near": match & near}
    return rows.withColumns({n: F.when(known, c) for n, c in flags.items()})
