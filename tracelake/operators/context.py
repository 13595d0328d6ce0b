"""What is shown around a step: tiers, prefix views, paired turns, histories, error contexts, ancestors, cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import trace as X
from ..sources.staging import cut


def _run():
    return Window.partitionBy("trace_id")


def history_tiers(runs: DataFrame, focus: DataFrame) -> DataFrame:
    """For each ``focus(trace_id, focus)``, the events before it and the tier each is shown in."""
    rows = focus.join(runs.select("trace_id", "event_id", "pos", "event_type"), "trace_id").where("pos < focus")
    return rows.select("trace_id", "focus", "event_id", X.tier(F.abs(F.col("focus") - F.col("pos")), X.compress_role(F.col("event_type"))).alias("tier"))


def prefix_view(runs: DataFrame, k: int, pinned: Column) -> DataFrame:
    """The first and last k events and the pinned ones, with the number of events left out just before each."""
    n = F.count("*").over(_run())
    shown = runs.withColumn("n", n).where((F.col("pos") < k) | (F.col("pos") >= F.col("n") - k) | pinned)
    before = F.coalesce(F.lag("pos").over(_run().orderBy("pos")), F.lit(-1))
    return shown.withColumn("skipped", (F.col("pos") - before - 1).cast("int")).select("trace_id", "event_id", "pos", "skipped")


def paired_steps(runs: DataFrame, text: str = "text") -> DataFrame:
    """A document per step: what the environment said, then what the agent did, in order."""
    agent = (~F.col("event_type").isin(*X.ENVIRONMENT_TYPES)).cast("int")
    line = F.concat(F.col("event_type"), F.lit(": "), F.coalesce(F.col(text), F.lit("")))
    rows = runs.where("step_index is not null").groupBy("trace_id", "step_index").agg(F.array_sort(F.collect_list(F.struct(agent.alias("agent"), F.col("pos"), line.alias("line")))).alias("lines"))
    return rows.select("trace_id", "step_index", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("doc"))


def step_history(runs: DataFrame, k: int | None = None) -> DataFrame:
    """How many events are before each (the last k of them, if bounded) and where that frame begins."""
    w = _run().orderBy("pos").rowsBetween(Window.unboundedPreceding if k is None else -k, -1)
    return runs.select("trace_id", "event_id", F.count("*").over(w).alias("n_before"), F.min("pos").over(w).alias("from_pos"))


def previous_step(steps: DataFrame) -> DataFrame:
    """The step number just before each one in order, however sparse."""
    rows = steps.where("step_index is not null").select("trace_id", "step_index").distinct()
    return rows.withColumn("previous", F.lag("step_index").over(_run().orderBy("step_index")))


def error_context(runs: DataFrame, marks: DataFrame) -> DataFrame:
    """Steps t-1, t and t+1 that a run has, for each ``marks(trace_id, t)``; without any, the nearest step (the lesser on ties)."""
    steps = runs.where("step_index is not null").select("trace_id", "step_index").distinct()
    rows = marks.select("trace_id", "t", F.explode(F.array(F.col("t") - 1, F.col("t"), F.col("t") + 1)).alias("step_index")).join(steps, ["trace_id", "step_index"])
    held = rows.groupBy("trace_id", "t").agg(F.array_sort(F.collect_list("step_index")).alias("steps"))
    alone = marks.join(held, ["trace_id", "t"], "left_anti")
    nearest = alone.join(steps, "trace_id").groupBy("trace_id", "t").agg(F.array(F.min(F.struct(F.abs(F.col("step_index") - F.col("t")).alias("d"), "step_index"))["step_index"]).alias("steps"))
    return held.unionByName(nearest)


def before_after(runs: DataFrame, before: Column, after: Column) -> DataFrame:
    """A step's picture before it: its own, else the one after the event just before."""
    rows = runs.withColumns({"b": before, "a": after})
    return rows.select("trace_id", "event_id", F.coalesce("b", F.lag("a").over(_run().orderBy("pos"))).alias("before_image"), F.col("a").alias("after_image"))


def merged_summaries(runs: DataFrame, summaries: DataFrame) -> DataFrame:
    """Steps with their summary; of several for a step the last counts."""
    last = summaries.groupBy("trace_id", "step_index").agg(F.max_by("summary", "ord").alias("summary"))
    return runs.select("trace_id", "event_id", "step_index").join(last, ["trace_id", "step_index"], "left")


def nearest_kept(parents: DataFrame, depth: int = 1 << 20) -> DataFrame:
    """``(trace_id, event_id, parent_id, kept)`` to the nearest kept ancestor, null where there is none or the chain turns in a circle.

    Pointer jumping over excluded parents: a pass doubles the hops, so a chain of 2^p is done in p passes, and passes
    end when every kept event has its ancestor.
    """
    keep = parents.where("kept").select("trace_id", F.col("event_id").alias("parent_id"), F.lit(True).alias("good"))
    out = parents.join(keep, ["trace_id", "parent_id"], "left").select("trace_id", "event_id", "kept", "parent_id", F.coalesce("good", F.col("parent_id").isNull()).alias("done"))
    out, hops = cut(out), 1
    while hops < depth and not out.where("kept and not done").isEmpty():
        up = out.where("not kept").select("trace_id", F.col("event_id").alias("parent_id"), F.col("parent_id").alias("next"), F.col("done").alias("next_done"), F.lit(True).alias("seen"))
        joined = out.join(up, ["trace_id", "parent_id"], "left")
        go = ~F.col("done") & F.col("seen").isNotNull()
        out = cut(joined.select("trace_id", "event_id", "kept", F.when(go, F.col("next")).otherwise(F.col("parent_id")).alias("parent_id"), F.when(go, F.col("next_done")).otherwise(F.col("done")).alias("done")))
        hops *= 2
    return out.where("kept").select("trace_id", "event_id", F.when(F.col("done"), F.col("parent_id")).alias("kept_parent"))


def verify_quotes(findings: DataFrame, runs: DataFrame, scope: dict[str, tuple[str, ...]], goals: DataFrame) -> DataFrame:
    """Whether a finding's quotes are in the trace, three-valued: null without quotes.

    The wrong quote has to be in the blamed event (by id); the reference quote in an event of a type that
    the conflict axis allows (any without an axis; for ``self`` up to the blamed step; for ``task`` and
    without an axis also in the goal). Quotes and texts are compared normalised.
    """
    from ..functions.text import quote_norm, squeeze, unescape

    norm = lambda c: squeeze(unescape(c))
    f = findings.withColumns({"wrong_n": quote_norm(F.col("wrong")), "ref_n": quote_norm(F.col("reference"))})
    events = runs.select("trace_id", F.col("event_id").alias("e_id"), "event_type", F.col("step_index").alias("e_step"), norm(F.col("text")).alias("said"))
    blamed = f.join(events.select("trace_id", F.col("e_id").alias("event_id"), F.col("said").alias("source"), F.col("e_step").alias("cutoff")), ["trace_id", "event_id"], "left")
    wrong_ok = F.col("wrong").isNull() | (F.col("wrong_n") != "") & F.coalesce(F.contains("source", F.col("wrong_n")), F.lit(False))
    allowed = F.col("axis").isNull()
    for axis, kinds in scope.items():
        one = (F.col("axis") == axis) & F.col("event_type").isin(*kinds)
        if axis == "self":
            one = (F.col("axis") == axis) & ((F.col("event_type").isin(*kinds) & (F.col("cutoff").isNull() | F.coalesce(F.col("e_step") <= F.col("cutoff"), F.lit(False)))) | (F.col("e_id") == F.col("event_id")))
        allowed = allowed | F.coalesce(one, F.lit(False))
    # a quote is searched in its own run only, and one row a finding comes back
    cited = blamed.where("reference is not null and ref_n <> ''").join(events, "trace_id").groupBy("finding_id").agg(F.bool_or(allowed & F.contains("said", F.col("ref_n"))).alias("in_events"))
    rows = blamed.join(cited, "finding_id", "left").join(goals, "trace_id", "left")
    in_goal = (F.col("axis").isNull() | (F.col("axis") == "task")) & F.coalesce(F.contains(norm(F.col("goal")), F.col("ref_n")), F.lit(False))
    ref_ok = F.col("reference").isNull() | (F.col("ref_n") != "") & (F.coalesce("in_events", F.lit(False)) | in_goal)
    return rows.select("trace_id", "finding_id", F.when(F.col("wrong").isNotNull() | F.col("reference").isNotNull(), wrong_ok & ref_ok).alias("quote_verified"))


def verification_summary(verified: DataFrame) -> DataFrame:
    v = F.col("quote_verified")
    return verified.agg(F.count_if(v).alias("verified"), F.count_if(~v).alias("unsupported"), F.count_if(v.isNull()).alias("unchecked"))


def bisect(runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Where a bisection that always picks the half with ``wanted(trace_id, target)`` ends: the rounds it takes and the position left.

    The upper half of n events is the first max(1, n div 2); the arithmetic runs as one fold over rounds.
    """
    sized = runs.groupBy("trace_id").agg(F.count("*").alias("n")).join(wanted, "trace_id")
    start = F.struct(F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi"), F.lit(0).alias("rounds"))

    def step(s: Column, _: Column) -> Column:
        half = s["lo"] + F.greatest(F.lit(1), F.floor((s["hi"] - s["lo"]) / 2))
        first = F.col("target") < half
        moved = F.struct(F.when(first, s["lo"]).otherwise(half).cast("long").alias("lo"), F.when(first, half).otherwise(s["hi"]).cast("long").alias("hi"), (s["rounds"] + 1).alias("rounds"))
        return F.when(s["hi"] - s["lo"] <= 1, s).otherwise(moved)

    out = sized.withColumn("s", F.reduce(F.sequence(F.lit(1), F.lit(64)), start, step))
    return out.select("trace_id", F.col("s.lo").alias("found"), F.col("s.rounds").alias("rounds"))
