"""Stores as tables: appends, upserts, pages, sequences, imports by fingerprint, status counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import numbered


def append(rows: DataFrame, path: str) -> None:
    """One JSON object a row, after what is there."""
    rows.write.mode("append").json(path)


def last_written(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Lookup by key: the last row written counts."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.col(order)).alias("r")).select(key, "r.*")


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """The new rows, and the old ones of other keys; of repeated new keys the last by ``updated_at`` counts."""
    w = Window.partitionBy(*keys).orderBy(F.desc("updated_at"))
    fresh = new.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
    return old.join(fresh.select(*keys), list(keys), "left_anti").unionByName(fresh)


def newest_first(rows: DataFrame, order: str, *ties: str) -> DataFrame:
    """Listing order: newest first; ``place`` is 0-based."""
    return numbered(rows, F.desc(order), *ties).withColumn("place", F.col("place").cast("int"))


def page(rows: DataFrame, after: int, limit: int) -> DataFrame:
    """The next rows of each discussion after a sequence number."""
    limit = min(1000, max(1, limit))
    return rows.where(F.col("sequence") > after).withColumn("r", F.row_number().over(Window.partitionBy("discussion").orderBy("sequence"))).where(F.col("r") <= limit).drop("r")


def next_sequence(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """New rows numbered after the greatest sequence of their key."""
    most = old.groupBy(key).agg(F.max("sequence").alias("most"))
    at = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return new.join(most, key, "left").withColumn("sequence", F.coalesce("most", F.lit(0)) + at).drop("most")


def import_sync(stored: DataFrame, found: DataFrame) -> DataFrame:
    """``(id, fingerprint)`` found against stored: imported, updated, skipped, or failed without a fingerprint."""
    rows = found.join(stored.select("id", F.col("fingerprint").alias("was"), F.lit(True).alias("known")), "id", "left")
    state = F.when(F.col("fingerprint").isNull(), "failed").when(F.col("known").isNull(), "imported").when(F.col("was").eqNullSafe(F.col("fingerprint")), "skipped").otherwise("updated")
    return rows.select("id", state.alias("state"))


def batch_totals(records: DataFrame) -> DataFrame:
    """A batch's counts and its overall state."""
    ok = F.count_if("ok")
    total = F.count("*")
    return records.groupBy("batch").agg(total.alias("total"), ok.alias("succeeded"), (total - ok).alias("failed"), F.when(ok == total, "completed").when(ok == 0, "failed").otherwise("partial").alias("state"))


def with_report(runs: DataFrame, reports: DataFrame) -> DataFrame:
    """Each run with its newest report; runs without one say so."""
    latest = reports.groupBy("trace_id").agg(F.max_by(F.struct("report_id", "parse_error"), F.struct("generated_at", "report_id")).alias("r"))
    state = F.when(F.col("r").isNull(), "not_run").when(F.col("r.parse_error"), "parse_error").otherwise("ready")
    return runs.select("trace_id").distinct().join(latest, "trace_id", "left").select("trace_id", F.col("r.report_id").alias("report_id"), state.alias("state"))


def memory_join(episodes: DataFrame, semantic: DataFrame, procedural: DataFrame, newest: int = 200) -> DataFrame:
    """The newest episodes with their descriptions and advice, where they have any."""
    return episodes.orderBy(F.desc("created"), F.desc("episode_id")).limit(newest).join(semantic, "episode_id", "left").join(procedural, "episode_id", "left")


def memory_rows(findings: DataFrame) -> DataFrame:
    """What is remembered of a run: distinct failure modes in order as one description, distinct suggestions."""
    by = findings.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "mode_id", "suggestion"))).alias("s"))
    each = lambda c: F.array_distinct(F.array_compact(F.transform("s", lambda x: x[c])))
    return by.select("trace_id", F.array_join(each("mode_id"), " | ").alias("description"), F.array_join(each("suggestion"), " | ").alias("suggestions"))


def unknown_citations(citations: DataFrame, events: DataFrame) -> DataFrame:
    """Cited event ids, each once, that no event of the run has; it has to be empty for a message to be kept."""
    return citations.select("trace_id", "event_id").distinct().join(events.select("trace_id", "event_id"), ["trace_id", "event_id"], "left_anti")
