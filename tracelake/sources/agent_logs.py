"""An agent host's two logs of a session: its transcript of messages, and the runtime's typed records.

Both are record tables ``(trace_id, line, record)``. What a header says holds from its line on, so it is carried
down the file by a window; parents are the last event before a line that its key names. Neither needs a
file's lines in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import trace as X
from .exports import _list, _numbered, _out, get

#: The agent's name where none is given, block and record kinds.
DEFAULT_AGENT = "openclaw-agent"
CALL_BLOCKS = ("tool_use", "toolUse", "toolCall")
RESULT_BLOCKS = ("tool_result", "toolResult")
RESULT_ROLES = ("toolresult", "tool_result")
CALL_IDS = ("tool_use_id", "toolUseId", "tool_call_id", "toolCallId")
RUNTIME_EVENTS = ("prompt.submitted", "tool.call", "tool.result", "model.completed")
RUNTIME_SILENT = ("session.started", "session.ended", "context.compiled")
GOAL_CHARS = 512


def _part(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _kind(v: Column) -> Column:
    """STRING, BOOLEAN, ARRAY<...>, OBJECT<...> and so on; empty where nothing is there."""
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def _string(v: Column, path: str = "$") -> Column:
    """A JSON string, an empty one too; null for any other value."""
    x = _part(v, path)
    return F.when(_kind(x) == "STRING", F.try_variant_get(x, "$", "string"))


def _flag(v: Column, *names: str) -> Column:
    """Whether one of the names holds something other than false, zero, empty text or nothing."""
    out = F.lit(False)
    for n in names:
        text = F.lower(F.try_variant_get(v, f"$.{n}", "string"))
        out = out | F.coalesce(~text.isin("", "false", "0"), F.lit(False))
    return out


def _joined(parts: Column) -> Column:
    """Texts a line each; null if there are none."""
    some = F.array_compact(parts)
    return F.when(F.size(some) > 0, F.array_join(some, "\n"))


def _block_text(b: Column) -> Column:
    inner = _part(b, "$.content")
    return F.coalesce(_string(b, "$.text"), _string(inner), _joined(F.transform(_list(inner), lambda s: F.coalesce(_string(s, "$.text"), _string(s)))))


def _blocks(content: Column) -> Column:
    """Content as blocks: a string is one text block, what is no object in a list is left out, other values have none."""
    one = F.array(F.parse_json(F.to_json(F.named_struct(F.lit("type"), F.lit("text"), F.lit("text"), _string(content)))))
    return F.when(_kind(content) == "STRING", one).otherwise(F.filter(_list(content), lambda b: _kind(b).startswith("OBJECT")))


def _call_id(block: Column, message: Column) -> Column:
    return F.coalesce(get(block, *CALL_IDS, "id"), get(message, *CALL_IDS))


def _up_to(*by: str):
    return Window.partitionBy(*by).orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def named(records: DataFrame, runtime: bool = False) -> DataFrame:
    """Records under their session's own name: a transcript's last header id, a runtime log's first traceId or sessionId; else the name they have."""
    w = Window.partitionBy("trace_id")
    r = F.col("record")
    if runtime:
        name = F.min_by(F.coalesce(get(r, "traceId", "sessionId"), F.lit("")), "line").over(w)
    else:
        name = F.max_by(get(r, "id"), F.when((get(r, "type") == "session") & get(r, "id").isNotNull(), F.col("line"))).over(w)
    return records.withColumn("own", name).select(F.coalesce(F.nullif("own", F.lit("")), "trace_id").alias("trace_id"), "line", "record")


def _with_parents(rows: DataFrame) -> DataFrame:
    """``of_message``: the last event of the last message before this line whose id is ``native``."""
    last = rows.where("message_id is not null").groupBy("trace_id", F.col("message_id").alias("native"), "line").agg(F.max_by("event_id", "pos").alias("given"))
    asked = rows.where("native is not null").select("trace_id", "native", "line").distinct().withColumn("given", F.lit(None).cast("string"))
    before = Window.partitionBy("trace_id", "native").orderBy("line").rangeBetween(Window.unboundedPreceding, -1)
    met = last.unionByName(asked).withColumn("of_message", F.last("given", ignorenulls=True).over(before)).where("given is null").drop("given")
    return rows.join(met, ["trace_id", "native", "line"], "left")


def session_events(records: DataFrame) -> DataFrame:
    """A transcript's events: user texts and others' are observations, the assistant's its responses, reasoning blocks reflections, and calls and results as they are.

    The agent is the last one named above a line. A result hangs on the last call of its id before it, else,
    like every other event, on the last event of the message that its record names as parent. Records that
    are no messages, null records, blank texts, messages without content and unknown blocks give no event;
    a message id that repeats names the last such message above. Result blocks without text keep a null output.
    """
    r, m = F.col("record"), F.col("message")
    agent = F.coalesce(F.last(F.when(get(r, "type") == "session-meta", get(r, "agentId")), ignorenulls=True).over(_up_to("trace_id")), F.lit(DEFAULT_AGENT))
    rows = records.select("trace_id", "line", "record", agent.alias("agent")).where((get(r, "type") == "message") & _kind(_part(r, "$.message")).startswith("OBJECT"))
    rows = rows.select("trace_id", "line", "agent", get(r, "id").alias("message_id"), get(r, "parentId", "parent_id").alias("native"), _part(r, "$.message").alias("message"))
    rows = rows.select("*", F.posexplode(_blocks(_part(m, "$.content"))).alias("block", "b"))
    role, kind, text = F.coalesce(get(m, "role"), F.lit("agent")), F.coalesce(get("b", "type"), F.lit("")), _block_text(F.col("b"))
    said, of_tool = kind == "text", F.lower(role).isin(*RESULT_ROLES)
    call, result = kind.isin(*CALL_BLOCKS), kind.isin(*RESULT_BLOCKS) | (said & of_tool)
    typed = F.when(said & ~F.coalesce(text.rlike(r"(?U)\S"), F.lit(False)), None).when(result, "tool.result").when(call, "tool.call").when(kind == "reasoning", "reflection").when(said, F.when(F.lower(role) == "assistant", "llm.response").otherwise("observation"))
    failed = result & (_flag(m, "isError", "is_error") | (~said & _flag(F.col("b"), "isError", "is_error")))
    tool = F.when(call, F.coalesce(get("b", "name", "toolName"), F.lit("tool"))).when(result, F.coalesce(F.when(~said, get("b", "toolName", "name")), get(m, "toolName", "tool_name"), F.lit("tool")))
    rows = rows.select(
        "trace_id", "line", "block", "message_id", "native", typed.alias("event_type"), F.when(call | result, _call_id(F.col("b"), m)).alias("call_id"), tool.alias("tool"),
        F.when((kind == "reasoning") | (F.lower(role) == "assistant"), F.col("agent")).when(F.lower(role) == "user", "user").otherwise(role).alias("speaker"), F.when(~failed & ~call, text).alias("output"), F.when(failed, text).alias("error"),
    ).where("event_type is not null")
    rows = _with_parents(_numbered(rows, "line", "block"))
    calls = Window.partitionBy("trace_id", "call_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    is_result = F.col("event_type") == "tool.result"
    of_call = lambda c: F.when(F.col("call_id").isNotNull() & is_result, F.last(F.when(F.col("event_type") == "tool.call", F.col(c)), ignorenulls=True).over(calls))
    return _out(rows, parent_event_id=F.coalesce(of_call("event_id"), "of_message"), agent_name=F.coalesce(of_call("tool"), "tool", "speaker"))


def session_runs(records: DataFrame) -> DataFrame:
    """What a transcript says of itself: its last header (session id, version, folder, start), its last agent id, the first user text as goal, and how many custom records and unknown blocks it has. ``has_header`` is false where none came."""
    r = F.col("record")
    kind, m = get(r, "type"), _part(r, "$.message")
    blocks = F.when(kind == "message", _blocks(_part(m, "$.content")))
    texts = F.filter(F.transform(F.filter(blocks, lambda b: get(b, "type") == "text"), _block_text), lambda t: F.coalesce(t, F.lit("")) != "")
    goal = F.when(get(m, "role") == "user", F.get(texts, F.lit(0)))
    known = ("text", "reasoning", *CALL_BLOCKS, *RESULT_BLOCKS)
    unknown = F.size(F.filter(blocks, lambda b: ~F.coalesce(get(b, "type").isin(*known), F.lit(False))))
    header, at = kind == "session", F.col("line")
    latest = lambda c, when: F.max_by(c, F.when(when, at))
    return records.groupBy("trace_id").agg(
        latest(get(r, "id"), header).alias("session_id"), latest(get(r, "version"), header).alias("version"), latest(get(r, "cwd"), header).alias("folder"), latest(X.timestamp_of(get(r, "timestamp")), header & X.timestamp_of(get(r, "timestamp")).isNotNull()).alias("started_at"),
        F.coalesce(latest(get(r, "agentId"), (kind == "session-meta") & get(r, "agentId").isNotNull()), F.lit(DEFAULT_AGENT)).alias("agent"), F.substring(F.trim(F.min_by(goal, F.when(goal.isNotNull(), at))), 1, GOAL_CHARS).alias("goal"),
        F.count_if(kind == "custom").alias("n_custom"), F.coalesce(F.sum(F.when(kind == "message", F.greatest(unknown, F.lit(0)))), F.lit(0)).cast("long").alias("n_unknown_blocks"), F.coalesce(F.bool_or(header), F.lit(False)).alias("has_header"),
    )


def _key_agent(r: Column) -> Column:
    """The last part of a session key; the whole key if that part is empty."""
    key = get(r, "sessionKey")
    return F.coalesce(F.nullif(F.element_at(F.split(key, ":"), -1), F.lit("")), key)


def _items_text(v: Column) -> Column:
    items = _list(v)
    return F.when(items.isNotNull(), _joined(F.transform(items, lambda x: F.coalesce(_string(x), get(x, "text", "content"))))).otherwise(F.nullif(F.try_variant_get(v, "$", "string"), F.lit("")))


def _answer(data: Column) -> Column:
    """A model's answer: its texts that aren't blank, else the last assistant message of the snapshot that has text."""
    texts = F.filter(F.transform(_list(data, "assistantTexts"), lambda t: _string(t)), lambda t: F.coalesce(t.rlike(r"(?U)\S"), F.lit(False)))
    of = lambda m: _joined(F.transform(_blocks(_part(m, "$.content")), lambda b: F.nullif(_block_text(b), F.lit(""))))
    said = F.array_compact(F.transform(F.filter(_list(data, "messagesSnapshot"), lambda m: F.coalesce(get(m, "role") == "assistant", F.lit(False))), of))
    return F.coalesce(_joined(texts), F.when(F.size(said) > 0, F.element_at(said, -1)))


def runtime_events(records: DataFrame) -> DataFrame:
    """A runtime log's events: prompts, calls, results and completed answers.

    The agent is named by the session key of the first record, and by those of later session starts from
    their line on. Only a result has a parent, the last call of its id before it; its text is an error where
    ``success`` is false, and stays an output where that is missing. Other kinds and null records give no event.
    """
    r = F.col("record")
    first = F.col("line") == F.min("line").over(Window.partitionBy("trace_id"))
    agent = F.coalesce(F.last(F.when(first | (get(r, "type") == "session.started"), _key_agent(r)), ignorenulls=True).over(_up_to("trace_id")), F.lit(DEFAULT_AGENT))
    kind, data = get(r, "type"), _part(r, "$.data")
    rows = records.select("trace_id", "line", "record", agent.alias("agent")).where(kind.isin(*RUNTIME_EVENTS))
    result, tool = kind == "tool.result", kind.isin("tool.call", "tool.result")
    failed = F.coalesce(result & (F.try_variant_get(data, "$.success", "boolean") == F.lit(False)), F.lit(False))
    text = F.when(kind == "prompt.submitted", F.coalesce(get(data, "prompt"), F.lit(""))).when(result, _items_text(_part(data, "$.contentItems"))).when(kind == "model.completed", _answer(data))
    typed = F.when(kind == "prompt.submitted", "observation").when(kind == "model.completed", "llm.response").otherwise(kind)
    name = F.when(kind == "prompt.submitted", "user").when(tool, F.coalesce(get(data, "name"), F.lit("tool"))).otherwise(F.col("agent"))
    rows = rows.select("trace_id", "line", typed.alias("event_type"), name.alias("agent_name"), F.when(tool, get(data, "toolCallId")).alias("call_id"), F.when(~failed, text).alias("output"), F.when(failed, text).alias("error"))
    rows = _numbered(rows, "line")
    calls = Window.partitionBy("trace_id", "call_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    call = F.last(F.when(F.col("event_type") == "tool.call", F.col("event_id")), ignorenulls=True).over(calls)
    return _out(rows, parent_event_id=F.when((F.col("event_type") == "tool.result") & F.col("call_id").isNotNull(), call))


def runtime_runs(records: DataFrame) -> DataFrame:
    """What a runtime log says of its run: the first start, the last end with its status, whether it timed out, the first prompt as goal, and its records of unknown kinds."""
    r, at = F.col("record"), F.col("line")
    kind, data = get(r, "type"), _part(r, "$.data")
    ts = X.timestamp_of(get(r, "ts"))
    first = lambda c, when: F.min_by(c, F.when(when, at))
    last = lambda c, when: F.max_by(c, F.when(when, at))
    prompt = get(data, "prompt")
    return records.groupBy("trace_id").agg(
        F.min_by(F.coalesce(get(r, "sessionId"), F.lit("")), "line").alias("session_id"), F.min_by(F.coalesce(get(r, "modelId"), F.lit("")), "line").alias("model"), first(ts, (kind == "session.started") & ts.isNotNull()).alias("started_at"), last(ts, (kind == "session.ended") & ts.isNotNull()).alias("ended_at"),
        last(get(data, "status"), kind == "session.ended").alias("status"), F.coalesce(last(_flag(data, "timedOut"), kind == "session.ended"), F.lit(False)).alias("timed_out"), F.substring(F.trim(first(prompt, (kind == "prompt.submitted") & prompt.isNotNull())), 1, GOAL_CHARS).alias("goal"),
        F.count_if(r.isNotNull() & ~F.coalesce(kind.isin(*RUNTIME_EVENTS, *RUNTIME_SILENT), F.lit(False))).alias("n_unknown"),
    )
