"""Attribution of failed runs: spectrum scores, rank fusion, prefix divergence, candidate picking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squeeze


def signatures(runs: DataFrame) -> DataFrame:
    """Events with their spectrum signature; lifecycle events have none."""
    sig = F.concat_ws("|", "event_type", "agent_name", F.substring(squeeze(F.col("payload")), 1, 120))
    return runs.where(~F.col("event_type").isin("run.start", "run.end")).withColumn("signature", sig)


def spectrum(runs: DataFrame) -> DataFrame:
    """Per signature, failing and passing runs that hold it (ef, ep) of all (nf, np); each run counts once."""
    by_run = signatures(runs).groupBy("trace_id", "signature").agg(F.lit(1).alias("one"))
    flag = runs.groupBy("trace_id").agg(F.coalesce(F.bool_or(~F.col("success")), F.lit(False)).alias("failed"))
    totals = flag.agg(F.count_if("failed").alias("nf"), F.count_if(~F.col("failed")).alias("np"))
    counts = by_run.join(flag, "trace_id").groupBy("signature").agg(F.count_if("failed").alias("ef"), F.count_if(~F.col("failed")).alias("ep"))
    return counts.crossJoin(F.broadcast(totals))  # one row


def suspiciousness(counts: DataFrame, formula: str = "ochiai", exponent: float = 2.0) -> DataFrame:
    ef, ep, nf, np_ = (F.col(c).cast("double") for c in ("ef", "ep", "nf", "np"))
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    if formula == "tarantula":
        score = safe(safe(ef, nf), safe(ef, nf) + safe(ep, np_))
    elif formula == "ochiai":
        score = safe(ef, F.sqrt((ef + ep) * nf))
    elif formula == "dstar":
        rest = ep + (nf - ef)
        score = F.when((rest == 0) & (ef > 0), F.lit(float("inf"))).otherwise(safe(F.pow(ef, F.lit(exponent)), rest))
    else:
        raise ValueError(f"unknown formula {formula!r}")
    return counts.withColumn("score", score)


def spectrum_top(runs: DataFrame, formula: str = "ochiai", k: int = 5) -> DataFrame:
    """The k most suspicious steps of each failed run; on equal scores step 0 sorts last, then by position."""
    scored = suspiciousness(spectrum(runs), formula).select("signature", "score").where("score > 0")
    w = Window.partitionBy("trace_id")
    failed = signatures(runs).withColumn("failed", F.coalesce(F.bool_or(~F.col("success")).over(w), F.lit(False))).where("failed")
    rank = F.row_number().over(w.orderBy(F.desc("score"), F.coalesce(F.expr("nullif(pos, 0)"), F.lit(10**9)), "pos"))
    return failed.join(scored, "signature").withColumn("rank", rank).where(F.col("rank") <= k).select("trace_id", "event_id", "pos", "score", "rank")


def borda(hypotheses: DataFrame) -> DataFrame:
    """Rank fusion of (trace_id, method, rank, n, weight, event_id, confidence): points (n - rank) * weight, ties by weighted confidence."""
    by = hypotheses.groupBy("trace_id", "event_id").agg(
        F.sum((F.col("n") - F.col("rank")) * F.col("weight")).alias("points"), F.sum(F.col("weight") * F.col("confidence")).alias("mass"), F.sum("weight").alias("weights")
    )
    w = Window.partitionBy("trace_id").orderBy(F.desc("points"), F.desc("mass"), "event_id")
    return by.select("trace_id", "event_id", "points", F.least(F.lit(1.0), F.coalesce(F.try_divide("mass", "weights"), F.lit(0.0))).alias("confidence"), F.row_number().over(w).alias("rank"))


def noisy_or(hypotheses: DataFrame) -> DataFrame:
    """1 - prod(1 - clamp(weight * confidence)) per (run, event)."""
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("weight") * F.col("confidence")))
    return hypotheses.groupBy("trace_id", "event_id").agg((1 - F.product(1 - p)).alias("confidence"))


def ensemble(hypotheses: DataFrame, runs: DataFrame) -> DataFrame:
    """Each run's winner of the fused rankings; a run without hypotheses says so instead of falling silent."""
    best = borda(hypotheses).where("rank = 1").select("trace_id", "event_id")
    return runs.select("trace_id").distinct().join(best, "trace_id", "left").select("trace_id", "event_id", F.when(F.col("event_id").isNull(), "no_hypotheses").otherwise("ensemble").alias("method"))


def heuristic(found: DataFrame, runs: DataFrame) -> DataFrame:
    """Each run's earliest finding as its only hypothesis, with the reason where there is none."""
    w = Window.partitionBy("trace_id").orderBy(F.col("pos").isNull(), "pos", F.desc("confidence"), "phase", "event_id", "mode_id")
    first = found.withColumn("r", F.row_number().over(w)).where("r = 1").select("trace_id", "event_id")
    return runs.select("trace_id").distinct().join(first, "trace_id", "left").select("trace_id", "event_id", F.when(F.col("event_id").isNull(), "no_findings").otherwise("earliest").alias("method"))


def rescue_rank(rows: DataFrame) -> DataFrame:
    """Candidates by how often changing them rescues the run, then by confidence."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("trace_id").orderBy(F.desc("rescue"), F.desc("confidence"), "event_id")))


def actions(runs: DataFrame) -> DataFrame:
    """Tool calls as an ordered action sequence."""
    w = Window.partitionBy("trace_id").orderBy("pos")
    return runs.where("event_type = 'tool.call'").select("trace_id", (F.row_number().over(w) - 1).alias("ord"), "pos", F.concat_ws(":", "agent_name", "payload").alias("action"))


def diff_against(runs: DataFrame, pairs: DataFrame) -> DataFrame:
    """For (failed, reference) run pairs: length of the common action prefix and the step where they part."""
    a = actions(runs)
    left = pairs.join(a.select(F.col("trace_id").alias("failed"), "ord", F.col("pos").alias("step"), F.col("action").alias("x")), "failed")
    right = a.select(F.col("trace_id").alias("reference"), "ord", F.col("action").alias("y"))
    both = left.join(right, ["reference", "ord"], "left")
    apart = F.col("y").isNull() | (F.col("x") != F.col("y"))
    return both.groupBy("failed", "reference").agg(F.coalesce(F.min(F.when(apart, F.col("ord"))), F.count("*").cast("int")).alias("aligned"), F.min(F.when(apart, F.col("step"))).alias("divergence_step"))


def best_reference(diffs: DataFrame) -> DataFrame:
    """Per failed run, the reference with the longest common prefix (first id on ties)."""
    w = Window.partitionBy("failed").orderBy(F.desc("aligned"), "reference")
    return diffs.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def longest_prefix_references(runs: DataFrame, flag: DataFrame) -> DataFrame:
    """Per failed run of ``flag`` (trace_id, failed), the reference among all its passing runs: failed, reference, aligned, divergence_step.

    The longest common action prefix decides, then the least id. Runs meet by their prefixes, not in pairs: a
    prefix is known by its length and the sums of two 64-bit halves of its (place, action) digests, and has
    one reference, the least passing id that begins with it. A failed run without actions has the least
    passing id and no step; without passing runs there are no rows.
    """
    a = actions(runs)
    digest = F.md5(F.concat_ws(":", F.col("ord").cast("string"), "action"))
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(20,0)")
    w = Window.partitionBy("trace_id").orderBy("ord")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    halves = a.withColumns({"first": half(1), "second": half(17)})
    prefixes = halves.select("trace_id", (F.col("ord") + 1).alias("length"), "pos", F.lead("pos").over(w).alias("next"), F.sum("first").over(upto).alias("first"), F.sum("second").over(upto).alias("second")).join(flag, "trace_id")
    key = ["length", "first", "second"]
    known = prefixes.where("not failed").groupBy(*key).agg(F.min("trace_id").alias("reference"))
    met = prefixes.where("failed").join(known, key, "left")
    best = met.groupBy("trace_id").agg(F.max(F.when(F.col("reference").isNotNull(), F.struct("length", "reference", "next"))).alias("best"), F.min("pos").alias("start"))
    least = flag.where("not failed").agg(F.min("trace_id").alias("least")).where("least is not null")
    out = flag.where("failed").select("trace_id").join(best, "trace_id", "left").crossJoin(F.broadcast(least))  # one row
    step = F.when(F.col("best").isNull(), F.col("start")).otherwise(F.col("best.next"))
    return out.select(F.col("trace_id").alias("failed"), F.coalesce("best.reference", "least").alias("reference"), F.coalesce("best.length", F.lit(0)).alias("aligned"), step.alias("divergence_step"))


def divergence_candidates(diffs: DataFrame, runs: DataFrame) -> DataFrame:
    """Around the step where a run leaves its reference: the steps before, at and after it that the run has."""
    n = runs.groupBy(F.col("trace_id").alias("failed")).agg(F.count("*").alias("n"))
    d = F.col("divergence_step")
    near = F.filter(F.array(d - 1, d, d + 1), lambda x: (x >= 0) & (x < F.col("n")))
    return diffs.join(n, "failed").select("failed", "reference", "aligned", "divergence_step", F.when(d.isNull(), F.lit("")).otherwise(F.array_join(near.cast("array<string>"), ",")).alias("candidates"))


def counterfactual_candidates(runs: DataFrame, found: DataFrame, k: int = 5) -> DataFrame:
    """Events to try first: findings' events, then error events, then the tail from the end; each once, k a run."""
    a = found.select("trace_id", "event_id", F.lit(0).alias("tier"), F.col("pos").alias("at"))
    b = runs.where("error is not null and error <> ''").select("trace_id", "event_id", F.lit(1).alias("tier"), F.col("pos").alias("at"))
    c = runs.select("trace_id", "event_id", F.lit(2).alias("tier"), (-F.col("pos")).alias("at"))
    first = a.unionByName(b).unionByName(c).groupBy("trace_id", "event_id").agg(F.min(F.struct("tier", "at")).alias("o"))
    w = Window.partitionBy("trace_id").orderBy("o", "event_id")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("trace_id", "event_id", F.col("o.tier").alias("tier"), "rank")


def decision_events(runs: DataFrame) -> DataFrame:
    """Steps that an agent decided; a run without any keeps all its steps."""
    decided = ~F.col("event_type").isin("environment", "observation", "run.start", "run.end", "tool.call", "tool.result")
    any_ = F.bool_or(decided).over(Window.partitionBy("trace_id"))
    return runs.where("pos is not null").withColumn("keep", decided | ~any_).where("keep").drop("keep")


def multi_agent(runs: DataFrame) -> DataFrame:
    named = F.when(~F.col("agent_name").isin("environment", "agent", ""), F.col("agent_name"))
    return runs.groupBy("trace_id").agg((F.count_distinct(named) >= 2).alias("multi_agent"))
