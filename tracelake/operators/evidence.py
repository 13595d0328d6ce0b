"""Where a quote stands, what counts as evidence, and what may be shown or run again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squeeze
from .quotes import RUNGS, hits

UNSAFE_KEYS = ("path", "uri", "source_dir")


def locate(quotes: DataFrame, runs: DataFrame) -> DataFrame:
    """Where each quote is: the strictest of exact, normalised and canonical text, the anchor event first, then in order; ``at`` is its 1-based place if exact.

    :func:`quotes.place` gives the span in the source, tries quotes without their frames, and near misses.
    """
    rows = hits(quotes.withColumn("needle", F.col("quote")), runs)
    best = rows.groupBy("trace_id", "quote_id").agg(F.min(F.struct("rung", (~F.col("found_id").eqNullSafe(F.col("anchor"))).alias("other"), "pos", "found_id", F.when(F.col("rung") == 0, F.instr("said", F.col("quote"))).alias("at"))).alias("b"))
    out = quotes.select("trace_id", "quote_id").join(best, ["trace_id", "quote_id"], "left")
    return out.select("trace_id", "quote_id", F.get(F.array(*map(F.lit, RUNGS[:3])), F.col("b.rung")).alias("rung"), F.col("b.found_id").alias("event_id"), F.col("b.at").alias("at"))


def grounding(located: DataFrame, runs: DataFrame, blamed: DataFrame) -> DataFrame:
    """Whether a quote stands before, at or after the blamed event (by step, else by position), and whether it grounds the blame: it is found and not after; null without a quote found."""
    at = runs.select("trace_id", "event_id", F.col("step_index").alias("q_step"), F.col("pos").alias("q_pos"))
    b = blamed.join(runs.select("trace_id", F.col("event_id").alias("blamed_id"), F.col("step_index").alias("b_step"), F.col("pos").alias("b_pos")), ["trace_id", "blamed_id"])
    rows = located.join(at, ["trace_id", "event_id"], "left").join(b, "trace_id")
    d = F.coalesce(F.col("q_step") - F.col("b_step"), F.col("q_pos") - F.col("b_pos"))
    place = F.when(d < 0, "before").when(d == 0, "at").when(d > 0, "after")
    return rows.select("trace_id", "quote_id", place.alias("position"), (d <= 0).alias("grounded"))


def valid_evidence(cited: DataFrame, runs: DataFrame) -> DataFrame:
    """Quotes that are in the event they cite; uncited ones only where exactly one event of the run has them. Each once."""
    said = runs.select("trace_id", F.col("event_id").alias("e"), squeeze(F.col("text")).alias("said"))
    rows = cited.withColumn("q", squeeze(F.col("quote"))).where("q <> ''").join(said, "trace_id").where(F.contains("said", F.col("q")) & (F.col("event_id").isNull() | (F.col("event_id") == F.col("e"))))
    n = F.count("*").over(Window.partitionBy("trace_id", "quote_id"))
    return rows.withColumn("n", n).where("event_id is not null or n = 1").select("trace_id", F.col("e").alias("event_id"), F.col("q").alias("quote")).distinct()


def safe_details(details: Column) -> Column:
    """A map without keys that name places."""
    return F.map_filter(details, lambda k, _: ~F.lower(k).isin(*UNSAFE_KEYS))


def annotation_filter(rows: DataFrame, *, tags: tuple[str, ...] = (), apps: tuple[str, ...] = (), contains: str = "", assigned: str | None = None, done: DataFrame | None = None, annotated: bool | None = None) -> DataFrame:
    """Tasks to annotate: any of the tags and applications, assigned, with the text, annotated or not yet."""
    if tags:
        rows = rows.where(F.col("tag").isin(*tags))
    if apps:
        rows = rows.where(F.col("app").isin(*apps))
    if contains:
        rows = rows.where(F.contains(F.lower("text"), F.lit(contains.lower())))
    if assigned is not None:
        rows = rows.where(F.col("annotator") == assigned)
    if annotated is not None:
        rows = rows.join(done.select("task_id").distinct(), "task_id", "left_semi" if annotated else "left_anti")
    return rows


def live_result(payload: Column) -> Column:
    """The first reason why a live rerun's result can't be taken, null if it can."""
    get = lambda p, kind="string": F.try_variant_get(payload, f"$.{p}", kind)
    calls = F.size(F.filter(F.coalesce(get("events", "array<variant>"), F.array().cast("array<variant>")), lambda e: F.try_variant_get(e, "$.event_type", "string") == "tool.call"))
    n, seen = get("external_calls", "int"), get("observed", "boolean")
    return (
        F.when(F.coalesce(get("mode"), F.lit("")) != "live", "mode").when(seen.isNull(), "observed flag").when(F.coalesce(get("runner"), F.lit("")) == "", "runner").when(F.coalesce(get("framework"), F.lit("")) == "", "framework")
        .when(F.coalesce(n, F.lit(-1)) < 0, "count").when(seen != (n > 0), "flag and count").when(F.coalesce(F.size(get("events", "array<variant>")), F.lit(0)) == 0, "no events").when(calls < n, "fewer calls than declared")
    )


def known_tag(tag: Column, subtypes: tuple[str, ...], renamed: dict[str, str]) -> Column:
    """A tag that is known, or the new name of an old one, else null."""
    out = F.when(F.trim(tag).isin(*subtypes), F.trim(tag))
    for old, new in renamed.items():
        out = out.when(F.trim(tag) == old, new)
    return out


def select_row(rows: DataFrame, wanted: str) -> DataFrame:
    """The one row that ``wanted`` names by any of its ids or as ``row-<n>``; none or several are an error of their own."""
    hit = F.coalesce(F.col("trajectory_id") == wanted, F.lit(False)) | F.coalesce(F.col("task_id") == wanted, F.lit(False)) | (F.concat(F.lit("row-"), F.col("n").cast("string")) == wanted)
    found = rows.where(hit)
    state = F.when(F.count("*") == 0, "not found").when(F.count("*") == 1, "found").otherwise("ambiguous")
    return found.agg(state.alias("state"), F.min("n").alias("n"), F.count("*").alias("candidates"))


def expand_batch(lines: DataFrame) -> DataFrame:
    """``(file, line, value)`` to records; a line that doesn't parse is kept with its error, so no batch is dropped for it."""
    rows = lines.where("trim(value) <> ''").withColumn("record", F.try_parse_json("value"))
    at = F.row_number().over(Window.partitionBy("file").orderBy("line")) - 1
    return rows.select("file", at.alias("index"), "record", F.when(F.col("record").isNull(), "not JSON").alias("error"))
