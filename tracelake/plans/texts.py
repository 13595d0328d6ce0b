"""Queries of text and event functions, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import trace as X
from ..sources.fixtures import table
from .events import META_JSON, W, rich
from .registry import query

C = F.col
TURN = ["conv_id", "turn"]


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def _turn_query(name: str, sql: str, make, out: str) -> None:
    """A function of one conversation turn: SQL over (conv_id, turn, role, text)."""
    query(name, f"SELECT conv_id, turn, {sql} AS {out} FROM conversations")(lambda s, d: turns(s, d).select(*TURN, make().alias(out)))


def _event_query(name: str, sql: str, make, out: str) -> None:
    query(name, W + f"SELECT event_id, {sql} AS {out} FROM rich")(lambda s, d: rich(s, d).select("event_id", make().alias(out)))


SPACE = r"regexp_replace({}, '[\s\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g')"
_turn_query("text_squeeze", "trim(" + SPACE.format("text") + ")", lambda: T.squeeze(C("text")), "squeezed")
_turn_query("text_truncate", "CASE WHEN length(text) > 40 THEN concat(left(text, 40), '...') ELSE text END", lambda: T.truncate(C("text"), 40), "short")
_turn_query("text_bound", "CASE WHEN length(text) > 50 THEN concat(left(text, 50), '<truncated>') ELSE text END", lambda: X.bound(C("text"), 50), "bounded")
_turn_query("text_compact", "CASE WHEN length(text) > 60 THEN concat(left(text, 60), '…') ELSE text END", lambda: X.compact(C("text"), 60), "compact")
_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)
_TERMS = f"list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 2 AND x NOT IN ({_STOP}))"
_turn_query("text_terms", f"array_to_string(list_sort(list_distinct({_TERMS})), ' ')", lambda: F.array_join(F.array_sort(X.tokens(C("text"))), " "), "terms")
_turn_query("text_merge_tokens", "array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: length(x) >= 2))), ' ')", lambda: F.array_join(F.array_sort(X.tokens(C("text"), "merge")), " "), "tokens")
_turn_query("text_slug", f"CASE WHEN len({_TERMS}) = 0 THEN 'pattern' ELSE array_to_string(({_TERMS})[1:3], '_') END", lambda: X.slug(C("text")), "slug")
_turn_query("text_canonical_quote", "concat(trim(" + SPACE.format("translate(text, concat(chr(34), chr(39), '`‘’“”'), '')") + "), ' x')", lambda: T.canonical(F.concat(C("text"), F.lit(' \\"x\\" ... [truncated]'))), "canonical")
_turn_query("text_record_id", r"regexp_replace(regexp_replace(concat('/', text, ' é!'), '[^A-Za-z0-9._-]+', '__', 'g'), '^_+|_+$', '', 'g')", lambda: X.record_id(F.concat(F.lit("/"), F.col("text"), F.lit(" é!"))), "record_id")
_turn_query("text_stable_trace_id", "CASE WHEN turn % 2 = 1 THEN concat('aeb_', regexp_replace(regexp_replace(concat('task/', conv_id, ' #', turn), '[^A-Za-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g')) ELSE concat('aeb_row_', lpad(cast(turn + 1 AS varchar), 4, '0'), '_', left(sha1(text), 16)) END", lambda: X.stable_trace_id(F.when(C("turn") % 2 == 1, F.concat(F.lit("task/"), C("conv_id").cast("string"), F.lit(" #"), C("turn").cast("string"))), C("text"), C("turn")), "trace_id")
_turn_query("text_observation_type", "CASE WHEN regexp_matches(lower(text), 'previous reflections:|current observation:') THEN 'observation' WHEN regexp_matches(lower(text), 'error|exception') THEN 'error' ELSE 'observation' END", lambda: X.observation_type(C("text")), "event_type")
_turn_query("text_action_type", "CASE WHEN regexp_matches(lower(text), '^(search|click|open|look|go to|goto|use|take|put|cool|heat|clean)') THEN 'tool.call' ELSE 'agent.step' END", lambda: X.action_type(C("text")), "event_type")
_turn_query("text_looks_like_error", "(" + " OR ".join(f"starts_with(lower(left(ltrim(concat(CASE turn % 4 WHEN 0 THEN '  Fatal: ' WHEN 1 THEN 'x permission denied' ELSE '' END, text)), 80)), '{p}')" for p in X.ERROR_PREFIXES) + ") OR regexp_matches(lower(split_part(ltrim(concat(CASE turn % 4 WHEN 0 THEN '  Fatal: ' WHEN 1 THEN 'x permission denied' ELSE '' END, text)), chr(10), 1)), 'command not found|no such file or directory|permission denied|non-zero exit')", lambda: X.looks_like_error(F.concat(F.when(C("turn") % 4 == 0, F.lit("  Fatal: ")).when(C("turn") % 4 == 1, F.lit("x permission denied")).otherwise(F.lit("")), C("text"))), "is_error")
_LINES = "string_split(concat(text, chr(10), '+ a', chr(10), '  # b', chr(10), CASE WHEN turn % 2 = 0 THEN '12: c' ELSE 'plain' END), chr(10))"
_turn_query("text_machine_generated", f"CASE WHEN conv_id % 7 = 0 THEN true ELSE len(list_filter({_LINES}, lambda x: regexp_matches(x, '^(    |\t|[+\\-|>])|^\\s*(\\$|#|at |File \")|^\\s*[0-9][^:]{{0,6}}:'))) >= 0.6 * len(list_filter({_LINES}, lambda x: trim(x) <> '')) END", lambda: X.machine_generated(F.concat(F.when(C("conv_id") % 7 == 0, F.lit("diff --git a b\n")).otherwise(F.lit("")), C("text"), F.lit("\n+ a\n  # b\n"), F.when(C("turn") % 2 == 0, F.lit("12: c")).otherwise(F.lit("plain")))), "machine")
_turn_query("text_json_block", "CASE turn % 3 WHEN 0 THEN concat('{\"a\":', conv_id, '}') WHEN 1 THEN concat('{\"b\":', turn, '}') END", lambda: F.to_json(X.json_block(F.when(C("turn") % 3 == 0, F.concat(F.lit("Sure:\n```json\n{\"a\": "), C("conv_id").cast("string"), F.lit("}\n```\n{x}"))).when(C("turn") % 3 == 1, F.concat(F.lit("so {\"b\": "), C("turn").cast("string"), F.lit("} it is"))).otherwise(F.lit("none {")))), "block")
_turn_query("text_fingerprint", "sha256(concat('{\"conv\":', conv_id, ',\"role\":\"', role, '\",\"turn\":', turn, '}'))", lambda: X.fingerprint(F.parse_json(F.to_json(F.struct("turn", "role", C("conv_id").alias("conv"))))), "fingerprint")
_turn_query("text_timestamp", "CASE turn % 4 WHEN 0 THEN '2026-01-02 03:04:05' WHEN 1 THEN '2023-11-14 22:13:20' WHEN 2 THEN '2023-11-14 22:13:20.5' END", lambda: F.regexp_replace(F.date_format(X.timestamp_of(F.when(C("turn") % 4 == 0, F.lit("2026-01-02T03:04:05Z")).when(C("turn") % 4 == 1, F.lit("1700000000")).when(C("turn") % 4 == 2, F.lit("1700000000500")).otherwise(F.lit("soon"))), "yyyy-MM-dd HH:mm:ss.S"), r"\.0$", ""), "at")
_turn_query("text_message_content", "CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN concat(text, chr(10), role) ELSE cast(turn AS varchar) END", lambda: X.content_text(F.try_variant_get(F.parse_json(F.when(C("turn") % 3 == 0, F.to_json(F.named_struct(F.lit("c"), C("text")))).when(C("turn") % 3 == 1, F.to_json(F.named_struct(F.lit("c"), F.array(F.named_struct(F.lit("text"), C("text"), F.lit("content"), F.lit(None).cast("string")), F.named_struct(F.lit("text"), F.lit(""), F.lit("content"), C("role")))))).otherwise(F.to_json(F.named_struct(F.lit("c"), C("turn"))))), "$.c", "variant")), "content")
_turn_query("text_goal", "CASE turn % 3 WHEN 0 THEN 'find it' WHEN 1 THEN role END", lambda: X.goal_of(F.parse_json(F.when(C("turn") % 3 == 0, F.lit('{"prompt": "p", "goal": " find it "}')).when(C("turn") % 3 == 1, F.to_json(F.named_struct(F.lit("goal"), F.lit("  "), F.lit("task"), C("role")))).otherwise(F.lit('{"goal": 5}')))), "goal")
_turn_query("text_retry_delay", "CASE WHEN turn % 5 = 0 THEN 2.5 ELSE least(60, pow(2, turn)) END::DOUBLE", lambda: X.retry_delay(C("turn"), F.when(C("turn") % 5 == 0, F.lit("2.5")).when(C("turn") % 5 == 1, F.lit("later"))), "seconds")
_turn_query("text_token_cost", "round((length(text) * 3.0 + turn * 15.0) / 1e6, 8)", lambda: X.token_cost(F.char_length("text"), C("turn"), 3.0, 15.0), "cost")

_event_query("event_compress_role", "CASE WHEN event_type IN ('tool.result', 'observation', 'error', 'memory.read') THEN 'compress' ELSE 'preserve' END", lambda: X.compress_role(C("event_type")), "role")
_event_query("event_labelled_text", f"concat('input: ', text, CASE WHEN coalesce(error, '') <> '' THEN concat(chr(10), 'error: ', error) ELSE '' END, chr(10), 'metadata: ', {META_JSON})", lambda: X.labelled_text(input=C("text"), error=C("error"), metadata=F.to_json("metadata")), "text")
_event_query("event_header", "concat('--- step=', coalesce(step_index, pos), ' type=', event_type, ' agent=', agent_name, ' event_id=', event_id, CASE WHEN pos % 2 = 0 THEN ' CONTEXT-ONLY' ELSE '' END, ' ---')", lambda: X.header(C("step_index"), C("pos"), C("event_type"), C("agent_name"), C("event_id"), C("pos") % 2 == 1), "header")
_event_query("event_module", "CASE WHEN event_type IN ('tool.call', 'tool.result') THEN 'action' WHEN event_type = 'llm.response' THEN 'llm' WHEN event_type IN ('plan', 'agent.step') THEN 'planning' WHEN event_type = 'observation' THEN 'environment' ELSE 'runtime' END", lambda: X.module_of(C("event_type")), "module")
_event_query("event_coerced_type", "CASE pos % 6 WHEN 0 THEN 'tool.result' WHEN 1 THEN 'agent.step' WHEN 2 THEN 'observation' WHEN 3 THEN 'tool.call' WHEN 4 THEN 'human.feedback' ELSE 'agent.step' END", lambda: X.coerce_type(F.element_at(F.array(*map(F.lit, ("TOOL_RESULT", "message", "User", "tool", "human.feedback", "weird"))), (C("pos") % 6 + 1).cast("int"))), "event_type")
_event_query("event_signature", "CASE WHEN NOT (event_type = 'run.start' OR (event_type = 'error' AND agent_name = 'system')) THEN concat_ws('|', event_type, agent_name, 'm', left(text, 10)) END", lambda: X.signature(C("event_type"), C("agent_name"), F.lit("m"), C("text"), 10), "signature")
_NAMES = ("FunctionSpan", "tool_start", "Generation", "handoff", "chain_end", "tool_usage_finished", "llm_call_completed", "task_started", "on_tool_error", "chat_model_start")
for _f, _make, _want in (
    ("span", X.span_type, ("tool.result", "tool.call", "llm.call", "handoff", "agent.step", "tool.result", "llm.call", "agent.step", "tool.result", "llm.call")),
    ("crew", X.crew_type, ("agent.step", "tool.call", "agent.step", "agent.step", "agent.step", "tool.result", "llm.response", "plan", "tool.call", "agent.step")),
    ("graph", X.graph_type, ("agent.step", "tool.call", "agent.step", "agent.step", "agent.step", "tool.call", "llm.call", "agent.step", "tool.result", "llm.call")),
):
    _event_query(f"event_{_f}_type", "CASE pos % 10 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_want)) + " END", lambda make=_make: make(F.element_at(F.array(*map(F.lit, _NAMES)), (C("pos") % 10 + 1).cast("int"))), "event_type")
_CALL = lambda: F.parse_json(F.when(C("pos") % 3 == 0, F.concat(F.lit('{"tool": "t'), C("text").substr(1, 2), F.lit('", "args": {"b": 1, "a": "x"}}'))).when(C("pos") % 3 == 1, F.lit('{"name": "n", "parameters": {"a": 2}}')).otherwise(F.lit('{"args": [1]}')))
_event_query("event_action_key", """CASE pos % 3 WHEN 0 THEN concat('t', left(text, 2), ':{"a":"x","b":1}') WHEN 1 THEN 'n:{"a":2}' END""", lambda: X.action_key(X.action(_CALL())), "key")
_event_query("event_action_differs", """CASE WHEN pos % 3 = 0 THEN true WHEN pos % 3 = 1 THEN false END""", lambda: X.action_key(X.action(_CALL())) != F.lit('n:{"a":2}'), "differs")
_event_query("event_tag_category", "CASE pos % 4 WHEN 0 THEN 'IF' WHEN 1 THEN 'G' WHEN 2 THEN 'IF' ELSE 'odd' END", lambda: X.category_of(F.element_at(F.array(*map(F.lit, (" Infeasible Task", "G12 ", "IF2", "odd"))), (C("pos") % 4 + 1).cast("int"))), "category")
_event_query("event_confidence_clamp", "least(0.9, greatest(0.1, CASE WHEN pos % 5 < 4 THEN pos % 5 / 3.0 ELSE 0 END))::DOUBLE", lambda: X.clamp(F.when(C("pos") % 5 < 4, C("pos") % 5 / 3.0), 0.1, 0.9), "confidence")
