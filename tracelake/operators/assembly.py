"""Histories that fit a budget, and blame narrowed to a step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters between two blocks.
GAP = 2


def fit(blocks: DataFrame, cap: int) -> DataFrame:
    """Which of a view's blocks are shown, and how, so that it has at most ``cap`` characters.

    ``blocks(trace_id, focus, pos, full, brief)``, ``brief`` null where ``full`` is the briefest form. The
    block farthest from the focus (ties: the earlier) gives up its detail first and then its place, then
    the next; the focus and the last block left are never touched. As each block waits for all beyond it,
    the state before it is a running sum from the far end, and it is touched while no state before was
    within the cap. Adds ``shown`` (null: dropped); null texts count as empty.
    """
    full, brief = F.coalesce("full", F.lit("")), F.coalesce("brief", "full", F.lit(""))
    rows = blocks.withColumns({"n_full": F.char_length(full), "n_brief": F.char_length(brief)})
    view = Window.partitionBy("trace_id", "focus")
    rows = rows.withColumns({"n": F.count("*").over(view), "whole": F.sum(F.col("n_full") + GAP).over(view) - GAP, "at": F.coalesce("focus", F.max("pos").over(view)), "has_focus": F.coalesce(F.max(F.col("pos") == F.col("focus")).over(view), F.lit(False))})
    is_focus = F.coalesce(F.col("pos") == F.col("focus"), F.lit(False))
    far = view.orderBy(is_focus, F.desc(F.abs(F.col("pos") - F.col("at"))), "pos")
    rows = rows.withColumn("rank", F.row_number().over(far))
    gone = F.coalesce(F.sum(F.col("n_full") + GAP).over(far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("before", F.col("whole") - gone).withColumn("after", F.col("before") - (F.col("n_full") - F.col("n_brief")))
    # the least of all states up to the one before a block's own turn
    least = F.min(F.least("before", "after")).over(far.rowsBetween(Window.unboundedPreceding, -1))
    last = F.col("rank") == F.col("n")  # the focus where it is shown, else the nearest
    over = F.coalesce(least > cap, F.lit(True)) & (F.col("before") > cap) & ~last
    out = rows.withColumn("shown", F.when(over & (F.col("after") > cap), None).when(over, brief).otherwise(full))
    return out.select(*blocks.columns, "shown")


def assemble(blocks: DataFrame, cap: int) -> DataFrame:
    """``(trace_id, focus, text, dropped)``: the blocks that fit, in order, two line breaks between them, and how many are left out."""
    shown = fit(blocks, cap).groupBy("trace_id", "focus").agg(F.array_sort(F.collect_list(F.when(F.col("shown").isNotNull(), F.struct("pos", "shown")))).alias("kept"), F.count_if(F.col("shown").isNull()).alias("dropped"))
    body = F.array_join(F.transform("kept", lambda b: b["shown"]), "\n\n")
    note = F.when(F.col("dropped") > 0, F.concat(F.lit("\n\n--- "), F.col("dropped").cast("string"), F.lit(" more step(s) omitted to fit the context budget ---"))).otherwise("")
    return shown.select("trace_id", "focus", F.concat(body, note).alias("text"), "dropped")


def chunk_blocks(runs: DataFrame, chunk: DataFrame, header: Column, full: Column, brief: Column) -> DataFrame:
    """Blocks of a run around ``chunk(trace_id, lo, hi)``: its own in full, the others briefly and marked, with the middle as focus."""
    inside = F.col("pos").between(F.col("lo"), F.col("hi"))
    rows = runs.join(chunk, "trace_id").withColumn("focus", F.floor((F.col("lo") + F.col("hi")) / 2).cast("int"))
    mark = F.when(inside, header).otherwise(F.regexp_replace(header, " ---$", " CONTEXT-ONLY ---"))
    body = lambda text: F.concat(mark, F.lit("\n"), F.coalesce(text, F.lit("")))
    return rows.select("trace_id", "focus", "pos", F.when(inside, body(full)).otherwise(body(brief)).alias("full"), F.when(inside, body(brief)).alias("brief"))


def chunk_view(runs: DataFrame, chunk: DataFrame, header: Column, full: Column, brief: Column, cap: int) -> DataFrame:
    """``(trace_id, focus, text, dropped)``: the run as context of a chunk, after a line that says which steps may be blamed."""
    out = assemble(chunk_blocks(runs, chunk, header, full, brief), cap)
    steps = runs.join(chunk, "trace_id").where(F.col("pos").between(F.col("lo"), F.col("hi"))).groupBy("trace_id").agg(F.min_by(F.coalesce("step_index", "pos"), "pos").alias("low"), F.max_by(F.coalesce("step_index", "pos"), "pos").alias("high"))
    told = F.concat(F.lit("You are judging steps "), F.col("low").cast("string"), F.lit(" to "), F.col("high").cast("string"), F.lit(" of this run. Steps marked CONTEXT-ONLY are context and never the failing step.\n\n"))
    return out.join(steps, "trace_id").select("trace_id", "focus", F.concat(told, "text").alias("text"), "dropped")


def narrow(runs: DataFrame, answers: DataFrame, picks: DataFrame, *, window: int = 3, floor: float | None = 0.75, rounds: int = 64) -> DataFrame:
    """A run's steps halved by answers until few are left: ``trace_id, root_step, low, high, probes, how``.

    ``answers(trace_id, low, high, half, confidence)`` hold what a judge says of steps low to high: the
    ``upper`` half (the first, with the middle) or the ``lower`` one; any other answer, or none, stops. It
    ends at ``window`` steps or after ``rounds``. With a confidence ``floor`` that the last answer reaches,
    the halving goes on to one step (``refined``); else ``picks(trace_id, step)`` decides (``picked``) if it
    names a step of the window, and otherwise the window's middle step does (``fallback``; without a floor
    its first). One run's steps and answers are folded inside one expression; runs without steps have no row.
    """
    steps = runs.where("step_index is not null").groupBy("trace_id").agg(F.array_sort(F.collect_set("step_index")).alias("steps"))
    said = answers.groupBy("trace_id").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("-", "low", "high").alias("key"), F.struct("half", F.coalesce("confidence", F.lit(0.5 if floor is not None else 0.0)).cast("double").alias("confidence")).alias("value")))).alias("said"))
    rows = steps.join(said, "trace_id", "left").join(picks.groupBy("trace_id").agg(F.min("step").alias("pick")), "trace_id", "left")
    state = lambda lo, hi, n, sure, stop: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), n.cast("int").alias("n"), sure.cast("double").alias("sure"), stop.alias("stop"))

    def halve(least: Column):
        def step(s: Column, _: Column) -> Column:
            at = lambda i: F.get("steps", i)
            mid = F.floor((s["lo"] + s["hi"]) / 2)
            a = F.try_element_at("said", F.concat_ws("-", at(s["lo"]), at(s["hi"])))
            half = F.coalesce(F.lower(F.trim(a["half"])), F.lit(""))
            moved = F.when(half == "upper", state(s["lo"], mid, s["n"] + 1, a["confidence"], F.lit(False))).when(half == "lower", state(mid + 1, s["hi"], s["n"] + 1, a["confidence"], F.lit(False)))
            return F.when(s["stop"] | (s["hi"] - s["lo"] + 1 <= least), s).otherwise(F.coalesce(moved, state(s["lo"], s["hi"], s["n"] + 1, s["sure"], F.lit(True))))

        return step

    start = state(F.lit(0), F.size("steps") - 1, F.lit(0), F.lit(1.0), F.lit(False))
    rows = rows.withColumn("s", F.reduce(F.sequence(F.lit(1), F.lit(rounds)), start, halve(F.lit(window))))
    sure = F.lit(False) if floor is None else F.col("s.sure") >= floor
    again = state(F.col("s.lo"), F.col("s.hi"), F.col("s.n"), F.col("s.sure"), F.lit(False))
    rows = rows.withColumn("t", F.when(sure & (F.col("s.hi") > F.col("s.lo")), F.reduce(F.sequence(F.lit(1), F.lit(64)), again, halve(F.lit(1)))))
    left = F.slice("steps", F.col("s.lo") + 1, F.col("s.hi") - F.col("s.lo") + 1)
    picked = F.when(F.array_contains(left, F.col("pick")), F.col("pick"))
    middle = F.get(left, F.lit(0) if floor is None else F.floor(F.size(left) / 2).cast("int"))
    single = F.size(left) == 1
    how = F.when(single, "single").when(F.col("t").isNotNull(), "refined").when(picked.isNotNull(), "picked").otherwise("fallback")
    root = F.when(single, F.get(left, F.lit(0))).when(F.col("t").isNotNull(), F.get("steps", F.col("t.lo"))).otherwise(F.coalesce(picked, middle))
    end = F.coalesce("t", "s")
    return rows.select("trace_id", root.alias("root_step"), F.get("steps", end["lo"]).alias("low"), F.get("steps", end["hi"]).alias("high"), end["n"].alias("probes"), how.alias("how"))


def topic_drift(events: DataFrame, goals: DataFrame, cosine: Column, *, threshold: float = 0.35, last: int = 60) -> DataFrame:
    """Events whose vector is less like the goal's than the threshold: ``trace_id, event_id, similarity``.

    ``events(trace_id, event_id, pos, event_type, vector)``; answers, plans and observations with a vector
    count, of each run the last ``last``; ``cosine`` compares ``vector`` with ``goal_vector``. Runs without a goal vector have no rows.
    """
    rows = events.where(F.col("event_type").isin("llm.response", "plan", "observation") & F.col("vector").isNotNull())
    rows = rows.withColumn("back", F.row_number().over(Window.partitionBy("trace_id").orderBy(F.desc("pos")))).where(F.col("back") <= last)
    return rows.join(goals.where("goal_vector is not null"), "trace_id").select("trace_id", "event_id", cosine.alias("similarity")).where(F.col("similarity") < threshold)
