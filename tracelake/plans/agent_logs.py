"""Queries of an agent host's transcript and runtime log, made from `conversations`: a turn's number says which record it is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources import agent_logs
from .imports import NULLS, C, L, records
from .registry import query

_TURNS = "WITH t AS (SELECT concat('c', conv_id) AS trace_id, conv_id, turn, text, regexp_matches(text, '\\S') AS said FROM conversations)"


def _blocks(*items: Column) -> Column:
    return F.array(*items)


def _block(kind: str, **x: Column) -> Column:
    n = L(None).cast("string")
    inner = x.get("content", L(None).cast("array<struct<text:string>>"))
    return F.struct(L(kind).alias("type"), *[x.get(k, n).alias(k) for k in ("text", "id", "name")], inner.alias("content"), x.get("isError", L(None).cast("boolean")).alias("isError"))


def _transcript() -> Column:
    turn, n = C("turn"), L(None).cast("string")
    at = lambda i, v: F.when(turn == i, v)
    kind = at(0, L("session")).when(turn.isin(1, 3, 4, 5, 6, 7), "message").when((turn == 2) & (C("conv_id") % 3 > 0), "session-meta").otherwise("custom")
    text = _block("text", text=C("text"))
    content = (
        at(1, _blocks(text)).when(turn == 3, _blocks(text, _block("toolCall", id=L("t3"), name=L("grep")))).when(turn == 4, _blocks(text)).when(turn == 5, _blocks(_block("reasoning", text=L("hm")), text))
        .when(turn == 6, _blocks(_block("tool_result", id=L("zz"), content=F.array(F.struct(C("text").alias("text")), F.struct(L("end").alias("text"))), isError=L(True)))).when(turn == 7, _blocks(_block("image"), text))
    )
    message = F.struct(F.when(turn.isin(1, 6), "user").when(turn.isin(3, 5), "assistant").when(turn == 4, "toolResult").otherwise("critic").alias("role"), content.alias("content"), at(4, L("t3")).alias("toolCallId"), at(4, C("conv_id") % 2 == 0).alias("isError"))
    parent = turn.isin(3, 4)
    return F.struct(
        kind.alias("type"), at(0, F.concat(L("s"), C("conv_id").cast("string"))).otherwise(F.concat(L("m"), turn.cast("string"))).alias("id"), F.when(parent, "m1").when(turn == 5, "m4").when(turn == 6, "m5").when(turn == 7, "m3").otherwise(n).alias("parentId"), at(2, F.concat(L("ag"), C("conv_id").cast("string"))).alias("agentId"),
        at(0, L(3)).alias("version"), at(0, L("/w")).alias("cwd"), at(0, L("2024-05-01T10:00:00Z")).alias("timestamp"), F.when(kind == "message", message).alias("message"),
    )


_AGENT = "CASE WHEN conv_id % 3 > 0 THEN concat('ag', conv_id) ELSE 'openclaw-agent' END"
_SESSION = _TURNS + f""", p AS (SELECT trace_id, turn, 0 AS part, 'observation' AS k, 'user' AS a, text AS o, {NULLS} AS x FROM t WHERE turn = 1 AND said UNION ALL SELECT trace_id, turn, 0, 'llm.response', {_AGENT}, text, NULL FROM t WHERE turn = 3 AND said UNION ALL SELECT trace_id, turn, 1, 'tool.call', 'grep', NULL, NULL FROM t WHERE turn = 3
 UNION ALL SELECT trace_id, turn, 0, 'tool.result', 'grep', CASE WHEN conv_id % 2 = 1 THEN text END, CASE WHEN conv_id % 2 = 0 THEN text END FROM t WHERE turn = 4 AND said UNION ALL SELECT trace_id, turn, 0, 'reflection', {_AGENT}, 'hm', NULL FROM t WHERE turn = 5 UNION ALL SELECT trace_id, turn, 1, 'llm.response', {_AGENT}, text, NULL FROM t WHERE turn = 5 AND said
 UNION ALL SELECT trace_id, turn, 0, 'tool.result', 'tool', NULL, concat(text, chr(10), 'end') FROM t WHERE turn = 6 UNION ALL SELECT trace_id, turn, 0, 'observation', 'critic', text, NULL FROM t WHERE turn = 7 AND said),
e AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY turn, part) - 1 AS i FROM p), l AS (SELECT trace_id, turn, max(i) AS last FROM e GROUP BY ALL)"""
query(
    "ingest_agent_transcript",
    _SESSION + " SELECT e.trace_id, cast(i AS int) AS pos, concat(e.trace_id, ':', i) AS event_id, CASE WHEN last IS NOT NULL THEN concat(e.trace_id, ':', last) END AS parent_event_id, k AS event_type, a AS agent_name, o AS output, x AS error FROM e LEFT JOIN l ON l.trace_id = e.trace_id AND l.turn = CASE e.turn WHEN 3 THEN 1 WHEN 4 THEN 3 WHEN 5 THEN 4 WHEN 6 THEN 5 WHEN 7 THEN 3 END",
)(lambda s, d: agent_logs.session_events(records(s, d, _transcript())))
query(
    "ingest_agent_transcript_runs",
    _TURNS + f" SELECT trace_id, max(CASE WHEN turn = 0 THEN concat('s', conv_id) END) AS session_id, CASE WHEN bool_or(turn = 0) THEN '3' END AS version, CASE WHEN bool_or(turn = 0) THEN '/w' END AS folder, CASE WHEN bool_or(turn = 2) AND max(conv_id) % 3 > 0 THEN concat('ag', max(conv_id)) ELSE 'openclaw-agent' END AS agent, max(CASE WHEN turn = 1 THEN left(trim(text), 512) END) AS goal, count(*) FILTER (turn > 7 OR (turn = 2 AND conv_id % 3 = 0)) AS n_custom, count(*) FILTER (turn = 7) AS n_unknown_blocks, bool_or(turn = 0) AS has_header FROM t GROUP BY trace_id",
)(lambda s, d: agent_logs.session_runs(records(s, d, _transcript())).drop("started_at"))


def _runtime() -> Column:
    turn, n = C("turn"), L(None).cast("string")
    k, odd = turn % 5, turn % 2 == 1
    one = F.struct(C("text").alias("text"))
    said = F.array(F.struct(L("assistant").alias("role"), C("text").alias("content")), F.struct(L("user").alias("role"), L("no").alias("content")))
    data = F.struct(
        F.when(k == 1, C("text")).alias("prompt"), F.when(k == 2, F.concat(L("c"), turn.cast("string"))).when(k == 3, F.concat(L("c"), (turn - 1).cast("string"))).alias("toolCallId"), F.when(k.isin(2, 3), "search").otherwise(n).alias("name"),
        F.when(k == 3, F.array(F.struct(L("found").alias("text")), one)).alias("contentItems"), F.when(k == 3, ~odd).alias("success"), F.when((k == 4) & ~odd, F.array(C("text"))).alias("assistantTexts"), F.when((k == 4) & odd, said).alias("messagesSnapshot"),
    )
    kind = F.element_at(F.array(*map(L, ("session.started", "prompt.submitted", "tool.call", "tool.result", "model.completed"))), (k + 1).cast("int"))
    return F.struct(L("openclaw-trajectory").alias("traceSchema"), kind.alias("type"), L("x").alias("sessionId"), F.concat(L("agent:main:b"), turn.cast("string")).alias("sessionKey"), L("m-1").alias("modelId"), data.alias("data"))


query(
    "ingest_agent_runtime",
    _TURNS + """, e AS (SELECT *, turn % 5 AS k, row_number() OVER (PARTITION BY trace_id ORDER BY turn) - 1 AS i FROM t WHERE turn % 5 > 0), f AS (SELECT trace_id, min(turn) AS first FROM t GROUP BY 1)
SELECT e.trace_id, cast(e.i AS int) AS pos, concat(e.trace_id, ':', e.i) AS event_id, CASE WHEN c.i IS NOT NULL THEN concat(e.trace_id, ':', c.i) END AS parent_event_id, CASE e.k WHEN 1 THEN 'observation' WHEN 2 THEN 'tool.call' WHEN 3 THEN 'tool.result' ELSE 'llm.response' END AS event_type, CASE WHEN e.k = 1 THEN 'user' WHEN e.k IN (2, 3) THEN 'search' ELSE concat('b', greatest(e.turn - e.turn % 5, first)) END AS agent_name,
 CASE WHEN e.k = 1 THEN e.text WHEN e.k = 3 AND e.turn % 2 = 0 THEN concat_ws(chr(10), 'found', nullif(e.text, '')) WHEN e.k = 4 AND ((e.turn % 2 = 0 AND e.said) OR (e.turn % 2 = 1 AND e.text <> '')) THEN e.text END AS output, CASE WHEN e.k = 3 AND e.turn % 2 = 1 THEN concat_ws(chr(10), 'found', nullif(e.text, '')) END AS error FROM e JOIN f USING (trace_id) LEFT JOIN e c ON e.k = 3 AND c.trace_id = e.trace_id AND c.turn = e.turn - 1""",
)(lambda s, d: agent_logs.runtime_events(records(s, d, _runtime())))
query(
    "ingest_agent_runtime_runs",
    _TURNS + " SELECT trace_id, 'x' AS session_id, 'm-1' AS model, arg_min(CASE WHEN turn % 5 = 1 THEN left(trim(text), 512) END, turn) FILTER (turn % 5 = 1 AND text <> '') AS goal, 0 AS n_unknown FROM t GROUP BY trace_id",
)(lambda s, d: agent_logs.runtime_runs(records(s, d, _runtime())).select("trace_id", "session_id", "model", "goal", "n_unknown"))
