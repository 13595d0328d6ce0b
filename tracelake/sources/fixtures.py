"""Views of the driver's tables as agent-run events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_runs(events: DataFrame) -> DataFrame:
    """One run per user: trace_id, event_id, pos, agent_name, event_type, payload, error, success, duration_ms, ts."""
    k = F.regexp_extract("props", "([0-9]+)", 1).try_cast("int")
    error = F.col("event_type") == "error"
    kind = F.when(F.col("event_type") == "click", "tool.call").when(F.col("event_type") == "purchase", "tool.result").when(F.col("event_type") == "view", "observation").when(F.col("event_type") == "signup", "plan").otherwise("error")
    # partitioned by trace_id itself, so that what follows per run needs no exchange of its own
    w = Window.partitionBy("trace_id").orderBy("ts", "event_id")
    return events.withColumn("trace_id", F.concat(F.lit("u"), F.col("user_id").cast("string"))).select(
        "trace_id",
        F.col("event_id").cast("string").alias("event_id"),
        (F.row_number().over(w) - 1).alias("pos"),
        F.concat(F.lit("agent_"), (k % 3).cast("string")).alias("agent_name"),
        kind.alias("event_type"),
        F.concat(F.lit("k="), (k % 5).cast("string")).alias("payload"),
        F.when(error, F.concat(F.lit("code "), (k % 7).cast("string"))).alias("error"),
        F.when(error & (k >= 95), F.lit(False)).alias("success"),
        F.col("value").alias("duration_ms"),
        F.col("ts"),
    )


def conversation_runs(conversations: DataFrame) -> DataFrame:
    """One run per conversation: role-mapped events with the goal taken from the first user turn."""
    kind = F.when(F.lower("role").isin("user", "human"), "observation").when(F.lower("role") == "system", "run.start").when(F.lower("role").isin("tool", "function"), "tool.result").otherwise("agent.step")
    w = Window.partitionBy("conv_id")
    goal = F.substring(F.min(F.when(F.lower("role").isin("user", "human"), F.struct("turn", "text"))).over(w)["text"], 1, 300)
    return conversations.select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("trace_id"),
        (F.row_number().over(w.orderBy("turn")) - 1).alias("pos"),
        F.col("role").alias("agent_name"),
        kind.alias("event_type"),
        F.col("text").alias("output"),
        goal.alias("goal"),
    )


#: The same view for the oracle.
EVT_SQL = """evt AS (
SELECT concat('u', cast(user_id AS varchar)) AS trace_id, cast(event_id AS varchar) AS event_id,
 cast(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS int) AS pos,
 concat('agent_', cast(k % 3 AS varchar)) AS agent_name,
 CASE event_type WHEN 'click' THEN 'tool.call' WHEN 'purchase' THEN 'tool.result' WHEN 'view' THEN 'observation' WHEN 'signup' THEN 'plan' ELSE 'error' END AS event_type,
 concat('k=', cast(k % 5 AS varchar)) AS payload,
 CASE WHEN event_type='error' THEN concat('code ', cast(k % 7 AS varchar)) END AS error,
 CASE WHEN event_type='error' AND k >= 95 THEN false END AS success, value AS duration_ms, ts
FROM (SELECT *, cast(regexp_extract(props,'([0-9]+)',1) AS int) AS k FROM events) e)"""


#: Metadata of a view event, by its position: name, condition, value.
_META = (("status", "pos % 9 = 4", "'FAILED'"), ("status", "pos % 9 = 5", "'Error'"), ("status", "true", "'ok'"), ("dropped_constraint", "pos % 13 = 6", "'budget'"), ("violated_constraint", "pos % 17 = 3", "'no spoilers'"), ("decision_error", "pos % 19 = 8", "'  late '"), ("capture_owned", "pos % 29 = 1", "true"))


def _meta(name: str) -> str:
    return "case " + " ".join(f"when {when} then {then}" for n, when, then in _META if n == name) + " end"


_KIND = "case when pos = 0 then 'run.start' when pos % 23 = 22 then 'reflection' when pos % 7 = 5 then 'llm.response' when pos % 7 = 3 then 'agent.step' else event_type end"
_SAID = "case payload when 'k=0' then 'Nothing happens.' when 'k=1' then 'No results for this item' when 'k=2' then 'All done, the task is complete' when 'k=3' then 'JSON schema in a loop' else 'ok' end"
_FRAMEWORK = "case cast(substr(trace_id, 2) as bigint) % 4 when 0 then 'alfworld' when 1 then 'WebShop env' else 'custom' end"
_SCALARS = {"step_index": "case when pos % 11 < 10 then cast(floor(pos / 2) as int) end", "kind": _KIND, "text": _SAID, "framework": _FRAMEWORK, **{n: _meta(n) for n in ("status", "dropped_constraint", "violated_constraint", "decision_error", "capture_owned")}}


def rich_runs(events: DataFrame) -> DataFrame:
    """event_runs with two events a step, more event types, free text, a framework and VARIANT metadata."""
    rows = event_runs(events).withColumns({n: F.expr(e) for n, e in _SCALARS.items()})
    meta = F.parse_json(F.to_json(F.struct("capture_owned", "decision_error", "dropped_constraint", "status", "success", "violated_constraint")))
    return rows.select("trace_id", "event_id", "pos", "step_index", "agent_name", F.col("kind").alias("event_type"), "text", "error", "framework", "duration_ms", meta.alias("metadata"))


#: The same for the oracle, with the metadata's fields as columns.
RICH_SQL = f"{EVT_SQL}, rich AS (SELECT trace_id, event_id, pos, agent_name, {', '.join(f'{e} AS {n}' for n, e in _SCALARS.items() if n != 'kind')}, {_KIND} AS event_type, error, success, duration_ms FROM evt)"
