"""Trace exports to events. A payload is a VARIANT, so each format is one projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TEXT = "coalesce(try_variant_get(m, '$.content', 'string'), try_variant_get(m, '$.value', 'string'), '')"


def lines(text: DataFrame) -> DataFrame:
    """Of a text column ``value``: parsed payloads, and lines that aren't JSON kept with an error flag; blank lines go."""
    return text.where("trim(value) <> ''").select("value", F.expr("try_parse_json(value)").alias("payload")).withColumn("malformed", F.col("payload").isNull())


def _events(payloads: DataFrame, path: str) -> DataFrame:
    rows = payloads.select("trace_id", F.expr(f"cast(variant_get(payload, '$.{path}', 'variant') as array<variant>)").alias("items"))
    return rows.select("trace_id", F.posexplode("items").alias("pos", "m"))


def messages(payloads: DataFrame) -> DataFrame:
    """(trace_id, payload) of message lists: a row per message, the type from its role."""
    role = F.lower(F.expr("coalesce(try_variant_get(m, '$.role', 'string'), '')"))
    kind = F.when(role.isin("user", "human"), "observation").when(role == "system", "run.start").when(role.isin("tool", "function"), "tool.result").otherwise("agent.step")
    return _events(payloads, "messages").select("trace_id", "pos", kind.alias("event_type"), role.alias("agent_name"), F.expr(_TEXT).alias("output"))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Last write per key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.col(order)).alias("r")).select(key, "r.*")
