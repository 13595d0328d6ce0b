"""Queries of the importers over exports made from `conversations`, with SQL that states their events from the table itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import exports
from ..sources.fixtures import table
from .registry import query

C = F.col
NS = F.named_struct
L = F.lit


def _trace() -> Column:
    return F.concat(L("c"), C("conv_id").cast("string")).alias("trace_id")


def payloads(spark: SparkSession, sf_dir: str, message: Column, wrap: str | None = "messages", extra: str = "") -> DataFrame:
    """A payload per conversation: its turns as ``message`` structs, as a list or under a key."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))).alias("t"))
    items = F.to_json(F.transform("t", lambda x: x["m"]))
    text = items if wrap is None else F.concat(L("{" + extra + f'"{wrap}":'), items, L("}"))
    return rows.select(_trace(), F.parse_json(text).alias("payload"))


def records(spark: SparkSession, sf_dir: str, record: Column) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(_trace(), C("turn").alias("line"), F.parse_json(F.to_json(record)).alias("record"))


#: Turns numbered within their conversation; `n` turns in all.
T = "WITH t AS (SELECT concat('c', conv_id) AS trace_id, conv_id, turn, role, text, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) "
NULLS = "NULL::VARCHAR"


def _events(kind: str, agent: str, output: str, error: str = NULLS, event_id: str = "concat(trace_id, ':', i)", parent: str = NULLS, trace: str = "trace_id", pos: str = "cast(i AS int)") -> str:
    return f"SELECT {trace} AS trace_id, {pos} AS pos, {event_id} AS event_id, {parent} AS parent_event_id, {kind} AS event_type, {agent} AS agent_name, {output} AS output, {error} AS error FROM t"


_choice = lambda n, *x: F.element_at(F.array(*[L(v) if isinstance(v, str) else v for v in x]), (C("turn") % n + 1).cast("int"))
_pick = lambda n, *x: f"CASE turn % {n} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(x)) + " END"

query("ingest_spans", T + _events(_pick(4, "'tool.call'", "'tool.result'", "'llm.call'", "'handoff'"), "role", "text", "CASE WHEN turn % 5 = 0 THEN 'bad' END", "concat('s', turn)", "CASE WHEN turn > 1 THEN concat('s', turn - 1) END"))(
    lambda s, d: exports.spans(payloads(s, d, NS(L("span_id"), F.concat(L("s"), C("turn").cast("string")), L("parent_id"), F.when(C("turn") > 1, F.concat(L("s"), (C("turn") - 1).cast("string"))), L("type"), _choice(4, "tool_call", "FunctionSpan", "generation", "Handoff"), L("agent"), C("role"), L("result"), C("text"), L("error"), F.when(C("turn") % 5 == 0, L("bad"))), "spans"))
)
query("ingest_crew_events", T + _events(_pick(5, "'plan'", "'tool.call'", "'tool.result'", "'llm.response'", "'agent.step'"), "CASE WHEN turn % 2 = 0 THEN role ELSE 'agent' END", "text"))(
    lambda s, d: exports.crew_events(payloads(s, d, NS(L("event"), _choice(5, "task_started", "tool_usage_started", "tool_usage_finished", "llm_call_completed", "crew_kickoff"), L("crew"), F.when(C("turn") % 2 == 0, C("role")), L("output"), C("text")), "events"))
)
query("ingest_graph_callbacks", T + _events(_pick(5, "'llm.call'", "'llm.response'", "'tool.call'", "'tool.result'", "'agent.step'"), "role", "text", event_id="concat('r', turn)", parent="CASE WHEN turn % 3 > 0 THEN 'root' END"))(
    lambda s, d: exports.graph_callbacks(payloads(s, d, NS(L("event"), _choice(5, "on_llm_start", "on_llm_end", "on_tool_start", "on_tool_error", "on_chain_start"), L("run_id"), F.concat(L("r"), C("turn").cast("string")), L("parent_run_id"), F.when(C("turn") % 3 > 0, L("root")), L("node"), C("role"), L("outputs"), C("text")), "events"))
)
query("ingest_event_list", T + _events(_pick(3, "'tool.result'", "'agent.step'", "'observation'"), "role", "text", event_id="CASE WHEN turn % 2 = 0 THEN concat('e', turn) ELSE concat(trace_id, ':', i) END", pos="cast(CASE WHEN turn % 4 = 0 THEN turn + 100 ELSE i END AS int)"))(
    lambda s, d: exports.event_list(payloads(s, d, NS(L("type"), _choice(3, "tool_result", "message", "user"), L("id"), F.when(C("turn") % 2 == 0, F.concat(L("e"), C("turn").cast("string"))), L("step"), F.when(C("turn") % 4 == 0, C("turn") + 100), L("role"), C("role"), L("content"), C("text")), "events"))
)
query("ingest_shop_pages", T + _events("'observation'", "'environment'", "text", trace="concat('webshop_', conv_id)", event_id="concat('webshop_', conv_id, ':', i)"))(
    lambda s, d: exports.shop_pages(payloads(s, d, NS(L("url"), F.concat(L("http://shop/item/"), C("conv_id").cast("string"), L("/")), L("page"), C("turn"), L("text"), C("text")), None))
)
query("ingest_unified", T + _events("CASE role WHEN 'user' THEN 'observation' WHEN 'system' THEN 'run.start' ELSE 'agent.step' END", "CASE WHEN turn % 2 = 0 THEN 'planner' ELSE role END", "text", event_id="concat(trace_id, ':step', i)"))(
    lambda s, d: exports.unified(_with_steps(payloads(s, d, NS(L("role"), C("role"), L("name"), F.when(C("turn") % 2 == 0, L("planner")), L("content"), C("text")), "messages")))
)


def _with_steps(rows: DataFrame) -> DataFrame:
    items = F.expr("cast(variant_get(payload, '$.messages', 'variant') as array<variant>)")
    step = F.transform(items, lambda m, i: NS(L("step"), i, L("role"), F.try_variant_get(m, "$.role", "string"), L("name"), F.try_variant_get(m, "$.name", "string"), L("content"), F.try_variant_get(m, "$.content", "string")))
    return rows.select("trace_id", F.parse_json(F.to_json(F.struct(step.alias("messages")))).alias("payload"))


query(
    "ingest_conversation_turns",
    T + """, p AS (SELECT trace_id, turn, role, 0 AS part, 'agent.step' AS event_type, 'so' AS output FROM t WHERE turn % 3 = 0 AND role <> 'system' UNION ALL SELECT trace_id, turn, role, 1, 'tool.call', concat('Search ', trim(text)) FROM t WHERE turn % 3 = 0 AND role <> 'system'
 UNION ALL SELECT trace_id, turn, role, 0, CASE WHEN regexp_matches(lower(text), 'previous reflections:|current observation:') THEN 'observation' WHEN regexp_matches(lower(text), 'error|exception') THEN 'error' ELSE 'observation' END, trim(text) FROM t WHERE turn % 3 > 0 AND role <> 'system' AND trim(text) <> ''),
q AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY turn, part) - 1 AS i FROM p) SELECT trace_id, cast(i AS int) AS pos, concat(trace_id, ':', i) AS event_id, NULL::VARCHAR AS parent_event_id, event_type, role AS agent_name, output, NULL::VARCHAR AS error FROM q""",
)(lambda s, d: exports.conversations(payloads(s, d, NS(L("from"), C("role"), L("value"), F.when(C("turn") % 3 == 0, F.concat(L("Thought: so\nAction: Search "), F.trim("text"))).otherwise(C("text"))), "conversations")))

# --- logs: every fifth record is of another kind


def _rollout_record() -> Column:
    n = L(None).cast("string")
    turn, k = C("turn"), C("turn") % 5
    call = F.concat(L("call"), (turn - F.when(k == 2, 1).when(k == 4, 3).otherwise(0)).cast("string"))
    inner = F.struct(
        F.when(k == 0, "message").when(k == 1, "function_call").when(k == 2, "function_call_output").when(k == 3, "token_count").otherwise("exec_command_end").alias("type"), F.when(k == 0, C("role")).alias("role"), F.when(k == 0, C("text")).alias("content"), F.when(k != 0, call).alias("call_id"), F.when(k == 1, L("shell")).otherwise(n).alias("name"),
        F.when(k == 2, C("text")).alias("output"), F.when(k == 4, turn % 2).alias("exit_code"), F.when(k == 4, C("text")).alias("formatted_output"), F.when(k == 4, C("text")).alias("aggregated_output"),
    )
    return F.struct(F.when(k.isin(0, 1, 2), "response_item").otherwise("event_msg").alias("type"), inner.alias("payload"))


_ROLLED = T + """, e AS (SELECT *, turn % 5 AS k, CASE WHEN turn % 5 = 0 AND role = 'system' THEN 'message.system' WHEN turn % 5 = 0 AND text = '' THEN concat('message.', role, '.empty') WHEN turn % 5 = 3 THEN 'event_msg.token_count' END AS ignored FROM t),
f AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY turn) - 1 AS j FROM e WHERE ignored IS NULL) """
query(
    "ingest_rollout",
    _ROLLED + """SELECT f.trace_id, cast(f.j AS int) AS pos, concat(f.trace_id, ':', f.j) AS event_id, coalesce(CASE WHEN g.j IS NOT NULL THEN concat(f.trace_id, ':', g.j) END, CASE WHEN f.j > 0 THEN concat(f.trace_id, ':', f.j - 1) END) AS parent_event_id,
 CASE f.k WHEN 0 THEN CASE WHEN f.role = 'user' THEN 'observation' ELSE 'llm.response' END WHEN 1 THEN 'tool.call' ELSE 'tool.result' END AS event_type, CASE f.k WHEN 0 THEN f.role WHEN 1 THEN 'shell' WHEN 2 THEN 'tool' ELSE 'exec_command' END AS agent_name,
 CASE WHEN f.k IN (0, 2) OR (f.k = 4 AND f.turn % 2 = 0) THEN f.text END AS output, CASE WHEN f.k = 4 AND f.turn % 2 = 1 THEN coalesce(nullif(f.text, ''), 'command failed') END AS error FROM f LEFT JOIN f g ON g.trace_id = f.trace_id AND f.k IN (2, 4) AND g.k = 1 AND g.turn = f.turn - CASE f.k WHEN 2 THEN 1 ELSE 3 END""",
)(lambda s, d: exports.rollout(records(s, d, _rollout_record())))
query("ingest_rollout_ignored", _ROLLED + "SELECT trace_id, ignored AS kind, count(*) AS n FROM e WHERE ignored IS NOT NULL GROUP BY ALL")(lambda s, d: exports.rollout_ignored(records(s, d, _rollout_record())))


def _session_record() -> Column:
    """Assistant records hold a thought, a text and a call of one message; user records the call's result, or text."""
    n, turn = L(None).cast("string"), C("turn")
    block = lambda kind, **x: F.struct(L(kind).alias("type"), *[x.get(k, n).alias(k) for k in ("thinking", "text", "id", "name", "tool_use_id", "content")], x.get("is_error", L(None).cast("boolean")).alias("is_error"))
    tid = lambda t: F.concat(L("u"), t.cast("string"))
    talk = F.array(block("thinking", thinking=L("hm")), block("text", text=C("text")), block("tool_use", id=tid(turn), name=L("grep")))
    back = F.array(block("tool_result", tool_use_id=tid(turn - 1), content=C("text"), is_error=turn % 4 == 0), block("text", text=L("go on")))
    agent = C("role") == "assistant"
    return F.struct(F.when(C("role") == "system", "summary").when(agent, "assistant").otherwise("user").alias("type"), tid(turn).alias("uuid"), F.when(turn > 0, tid(turn - 1)).alias("parentUuid"), F.struct(F.when(agent, "assistant").otherwise("user").alias("role"), F.when(agent, F.concat(L("m"), turn.cast("string"))).alias("id"), F.when(agent, talk).otherwise(back).alias("content")).alias("message"))


query(
    "ingest_session_log",
    T + """, b AS (SELECT trace_id, turn, text, 'assistant' AS role, unnest(['reflection', 'llm.response', 'tool.call']) AS k, unnest([0, 1, 2]) AS part FROM t WHERE role = 'assistant' UNION ALL SELECT trace_id, turn, text, 'user', unnest(['tool.result', 'observation']), unnest([0, 1]) FROM t WHERE role NOT IN ('assistant', 'system')),
e AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY turn, part) - 1 AS i FROM b WHERE NOT (k = 'llm.response' AND trim(text) = '')), l AS (SELECT trace_id, turn, max(i) AS last FROM e GROUP BY ALL), c AS (SELECT trace_id, turn, i AS called FROM e WHERE k = 'tool.call'), h AS (SELECT e.*, l.last, c.called, max(CASE WHEN k IN ('reflection', 'llm.response') THEN i END) OVER (PARTITION BY e.trace_id, e.turn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS chain FROM e LEFT JOIN l ON l.trace_id = e.trace_id AND l.turn = e.turn - 1 LEFT JOIN c ON c.trace_id = e.trace_id AND c.turn = e.turn - 1)
SELECT trace_id, cast(i AS int) AS pos, concat(trace_id, ':', i) AS event_id, CASE WHEN up IS NOT NULL THEN concat(trace_id, ':', up) END AS parent_event_id, k AS event_type, CASE k WHEN 'tool.call' THEN 'grep' WHEN 'tool.result' THEN CASE WHEN called IS NULL THEN 'tool' ELSE 'grep' END WHEN 'observation' THEN 'user' ELSE 'assistant' END AS agent_name,
 CASE k WHEN 'reflection' THEN 'hm' WHEN 'llm.response' THEN text WHEN 'tool.result' THEN CASE WHEN turn % 4 > 0 THEN text END WHEN 'observation' THEN 'go on' END AS output, CASE WHEN k = 'tool.result' AND turn % 4 = 0 THEN text END AS error
FROM (SELECT *, CASE k WHEN 'tool.result' THEN coalesce(called, last) WHEN 'observation' THEN last ELSE coalesce(chain, last) END AS up FROM h)""",
)(lambda s, d: exports.session_log(records(s, d, _session_record())))


def _hermes_message() -> Column:
    turn = C("turn")
    calls = F.when(turn % 3 == 0, F.concat(L('[{"id":"k'), turn.cast("string"), L('","function":{"name":"calc","arguments":"{}"}}]'))).when(turn % 3 == 1, L("{not json"))
    agent, tool = C("role") == "assistant", (C("role") == "user") & (turn % 2 == 0)
    return NS(L("role"), F.when(tool, "tool").otherwise(C("role")), L("content"), F.when(tool & (turn % 4 == 0), F.concat(L("Error "), C("text"))).otherwise(C("text")), L("reasoning"), F.when(agent, L("why")), L("tool_calls"), F.when(agent, calls), L("tool_call_id"), F.when(tool, F.concat(L("k"), (turn - 1).cast("string"))))


query(
    "ingest_hermes",
    T + """, m AS (SELECT *, CASE WHEN role = 'user' AND turn % 2 = 0 THEN 'tool' ELSE role END AS r, CASE WHEN role = 'user' AND turn % 4 = 0 THEN concat('Error ', text) ELSE text END AS c FROM t),
p AS (SELECT trace_id, turn, 0 AS part, 'reflection' AS k, 'assistant' AS a, 'why' AS o, NULL AS x FROM m WHERE r = 'assistant' UNION ALL SELECT trace_id, turn, 1, 'llm.response', 'assistant', c, NULL FROM m WHERE r = 'assistant' AND c <> '' UNION ALL SELECT trace_id, turn, 2, 'tool.call', 'calc', NULL, NULL FROM m WHERE r = 'assistant' AND turn % 3 = 0
 UNION ALL SELECT trace_id, turn, 0, 'tool.result', NULL, CASE WHEN turn % 4 > 0 AND NOT bad THEN c END, CASE WHEN turn % 4 = 0 OR bad THEN c END FROM (SELECT *, regexp_matches(lower(left(ltrim(c), 80)), '^(error|traceback \\(most|exception|fatal:|command failed|command exited with code|bash: |sh: |zsh: )') OR regexp_matches(lower(split_part(ltrim(c), chr(10), 1)), 'command not found|no such file or directory|permission denied|non-zero exit') AS bad FROM m WHERE r = 'tool') UNION ALL SELECT trace_id, turn, 0, 'observation', r, c, NULL FROM m WHERE r NOT IN ('assistant', 'tool', 'system') AND c <> ''),
e AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY turn, part) - 1 AS i FROM p), h AS (SELECT e.*, g.i AS of_call, max(CASE WHEN e.k IN ('reflection', 'llm.response') THEN e.i END) OVER (PARTITION BY e.trace_id, e.turn ORDER BY e.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS chain FROM e LEFT JOIN e g ON e.k = 'tool.result' AND g.k = 'tool.call' AND g.trace_id = e.trace_id AND g.turn = e.turn - 1)
SELECT trace_id, cast(i AS int) AS pos, concat(trace_id, ':', i) AS event_id, CASE WHEN k = 'tool.result' AND of_call IS NOT NULL THEN concat(trace_id, ':', of_call) WHEN k IN ('llm.response', 'tool.call') AND chain IS NOT NULL THEN concat(trace_id, ':', chain) END AS parent_event_id, k AS event_type, CASE WHEN k = 'tool.result' THEN CASE WHEN of_call IS NULL THEN 'tool' ELSE 'calc' END ELSE a END AS agent_name, o AS output, x AS error FROM h""",
)(lambda s, d: exports.hermes(payloads(s, d, _hermes_message(), extra='"source":"cli","started_at":1.5,')))


def _answer_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = C("turn")
    blob = F.when(turn % 4 == 3, C("role")).otherwise(F.concat(L("ChatMessage(role=<MessageRole.X: '"), F.when(turn % 4 == 0, "assistant").when(turn % 4 == 1, "tool-call").otherwise("tool-response"), L("'>, content=[{'type': 'text', 'text': 'Value "), turn.cast("string"), F.when(turn % 8 == 2, L(" Error: no")).otherwise(L("")), L("\\nnext'}], tool_calls=None)")))
    return payloads(spark, sf_dir, blob, "intermediate_steps", '"task":"q","prediction":"a",')


query(
    "ingest_answer_steps",
    T + """, s AS (SELECT trace_id, i + 1 AS i, CASE turn % 4 WHEN 0 THEN 'llm.response' WHEN 1 THEN 'tool.call' WHEN 2 THEN 'tool.result' ELSE 'observation' END AS k, CASE turn % 4 WHEN 0 THEN 'assistant' WHEN 1 THEN 'tool-call' WHEN 2 THEN 'tool-response' ELSE 'environment' END AS a, CASE WHEN turn % 4 = 3 THEN role WHEN turn % 8 <> 2 THEN concat('Value ', turn, chr(10), 'next') END AS o, CASE WHEN turn % 8 = 2 THEN concat('Value ', turn, ' Error: no', chr(10), 'next') END AS x FROM t
 UNION ALL SELECT DISTINCT trace_id, 0, 'run.start', 'system', 'q', NULL FROM t UNION ALL SELECT DISTINCT trace_id, n + 1, 'run.end', 'system', 'a', NULL FROM t) SELECT trace_id, cast(i AS int) AS pos, concat(trace_id, ':', i) AS event_id, NULL::VARCHAR AS parent_event_id, k AS event_type, a AS agent_name, o AS output, x AS error FROM s""",
)(lambda s, d: exports.answer_steps(_answer_payload(s, d)))


def _benchmark_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = payloads(spark, sf_dir, NS(L("role"), C("role"), L("content"), C("text")))
    bad = F.substring("trace_id", 2, 20).cast("long") % 5 == 0
    row = F.struct(F.concat(C("trace_id"), L("/x")).alias("trajectory_id"), F.when(bad, L("{broken")).otherwise(F.to_json("payload")).alias("full_trajectory"), L(2).alias("critical_failure_step"), F.array(L("memory"), L("plan")).alias("failure_types"))
    return rows.select(L(0).cast("long").alias("index"), F.to_json(row).alias("value"))


query(
    "ingest_benchmark_rows",
    T + """, r AS (SELECT concat('aeb_', trace_id, '_x') AS trace_id, i, role, text FROM t WHERE conv_id % 5 > 0 UNION ALL SELECT DISTINCT concat('aeb_', trace_id, '_x'), 0, 'assistant', '{broken' FROM t WHERE conv_id % 5 = 0)
SELECT trace_id, cast(i AS int) AS pos, concat(trace_id, '_evt_', CASE WHEN i < 999 THEN lpad(cast(i + 1 AS varchar), 3, '0') ELSE left(cast(i + 1 AS varchar), 3) END) AS event_id, NULL::VARCHAR AS parent_event_id, CASE role WHEN 'user' THEN 'observation' WHEN 'system' THEN 'run.start' ELSE 'agent.step' END AS event_type, role AS agent_name, text AS output, CASE WHEN i IN (1, 2) THEN 'critical failure: module=unknown; types=memory,plan' END AS error FROM r""",
)(lambda s, d: exports.benchmark_rows(_benchmark_lines(s, d)))


def _uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    obj = F.to_json(F.struct("conv_id", "turn"))
    text = F.when(C("turn") % 4 == 0, obj).when(C("turn") % 4 == 1, F.concat(L('[{"role":"user","content":"x"},'), L('{"role":"user","content":"y"}]'))).when(C("turn") % 4 == 2, F.concat(L("["), obj, L(","), obj, L("]"))).otherwise(F.concat(obj, L("\n\n{bad\n"), obj))
    return rows.select(F.concat_ws("-", C("conv_id").cast("string"), C("turn").cast("string")).alias("upload_id"), text.alias("text"))


query("ingest_upload_split", "WITH u AS (SELECT concat(conv_id, '-', turn) AS upload_id, turn % 4 AS k, conv_id, turn FROM conversations), p AS (SELECT *, unnest(range(0, CASE k WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 1 END)) AS piece FROM u) SELECT upload_id, cast(piece AS int) AS piece, k = 3 AND piece = 1 AS error, CASE WHEN k <> 1 AND NOT (k = 3 AND piece = 1) THEN turn END AS turn FROM p")(
    lambda s, d: exports.upload_split(_uploads(s, d)).select("upload_id", "piece", "error", F.try_variant_get("payload", "$.turn", "long").alias("turn"))
)


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload of each shape, dealt over the conversations."""
    shapes = (
        '{"trace_id":1,"events":[]}', '{"source":"s","started_at":1,"messages":[]}', '{"metadata":{},"messages":[{"step":0,"role":"user","content":""}]}', '{"messages":[]}', '{"conversations":[]}', '{"events":[{"event":"task_started"}]}', '{"events":[{"event":"on_tool_start","run_id":"1"}]}',
        '{"events":[{"type":"plan"}]}', '{"spans":[]}', '{"url":"u","content":"c"}', '[]', '[{"role":"user"}]', '[{"type":"plan"}]', '[{"span_id":"1"}]', '[{"url":"u","content":"c"}]', '[{"sessionId":"1","message":{}}]', '{"else":1}',
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.parse_json(F.element_at(F.array(*map(L, shapes)), ((C("conv_id") + C("turn")) % len(shapes) + 1).cast("int"))).alias("payload"))


_FORMATS = ("trajectory", "hermes", "unified", "messages", "conversations", "crew_events", "graph_callbacks", "event_list", "spans", "shop_pages", "message_list", "message_list", "event_list", "spans", "shop_pages", "session_records", None)
query("ingest_detect_format", "SELECT conv_id, turn, CASE (conv_id + turn) % 17 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(_FORMATS) if f) + " END AS format FROM conversations")(lambda s, d: _shapes(s, d).select("conv_id", "turn", exports.detect_format().alias("format")))
