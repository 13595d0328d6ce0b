"""Agents' trace exports to event rows: one projection per format over VARIANT payloads.

A payload table is ``(trace_id, payload)``; a record table ``(trace_id, line, record)`` holds the lines of
a log. Events come out as ``trace_id, pos, event_id, parent_event_id, event_type, agent_name, output,
error`` (less where a format has less); ids are ``trace:pos``, so a second import gives the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import trace as X

EVENT = ["trace_id", "pos", "event_id", "parent_event_id", "event_type", "agent_name", "output", "error"]
#: Record kinds that carry no event of their own, and how injected context begins.
SILENT_RECORDS = ("session_meta", "turn_context", "compacted")
SILENT_MESSAGES = ("agent_reasoning", "agent_reasoning_raw_content", "token_count", "user_message", "agent_message", "item_started", "item_completed")
CALLS = ("function_call", "custom_tool_call", "local_shell_call")
OUTPUTS = ("function_call_output", "custom_tool_call_output")
ROLES = ("system", "user", "assistant", "tool", "environment")
#: Fixed value: the schema that each record of a runtime log names.
RUNTIME_SCHEMA = "openclaw-trajectory"


def get(v: str | Column, *paths: str, kind: str = "string") -> Column:
    """The first path of a VARIANT that is there and isn't an empty string."""
    v = F.col(v) if isinstance(v, str) else v
    found = [F.try_variant_get(v, f"$.{p}", kind) for p in paths]
    return F.coalesce(*[F.nullif(x, F.lit("")) if kind == "string" else x for x in found])


def has(v: str | Column, *paths: str) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    out = F.lit(False)
    for p in paths:
        out = out | F.try_variant_get(v, f"$.{p}", "variant").isNotNull()
    return out


def _list(v: str | Column, path: str = "") -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return F.try_variant_get(v, f"$.{path}" if path else "$", "array<variant>")


def _all(items: Column, test) -> Column:
    return F.coalesce((F.size(items) > 0) & F.forall(items, test), F.lit(False))


def is_transcript(r: Column) -> Column:
    """A transcript's header, or one of its messages."""
    text = lambda path: F.schema_of_variant(F.try_variant_get(r, path, "variant")) == "STRING"
    return F.coalesce((get(r, "type") == "session") & text("$.id"), F.lit(False)) | F.coalesce((get(r, "type") == "message") & text("$.message.role"), F.lit(False))


def is_runtime(r: Column) -> Column:
    return F.coalesce(get(r, "traceSchema") == RUNTIME_SCHEMA, F.lit(False))


def detect_format(payload: str = "payload") -> Column:
    """The first shape that a payload has; null if it has none."""
    p, items = F.col(payload), _list(payload)
    crew = lambda x: F.lower(get(x, "event", "type", "name")).rlike("crew|task_|agent_execution|tool_usage")
    graph = lambda x: F.lower(get(x, "event", "type", "name")).rlike("^on_|chain|graph") | has(x, "run_id")
    shop = lambda x: has(x, "url", "page") & has(x, "content", "observation")
    hermes = has(p, "messages") & has(p, "source") & has(p, "started_at")
    unified = _all(_list(p, "messages"), lambda m: has(m, "step") & has(m, "role")) & has(p, "metadata")
    events = _list(p, "events")
    whole = (
        F.when(has(p, "trace_id") & has(p, "events"), "trajectory").when(hermes, "hermes").when(unified, "unified").when(_list(p, "messages").isNotNull(), "messages").when(_list(p, "conversations").isNotNull(), "conversations")
        .when(_all(events, crew), "crew_events").when(_all(events, graph), "graph_callbacks").when(events.isNotNull(), "event_list").when(_list(p, "spans").isNotNull(), "spans").when(shop(p), "shop_pages")
    )
    listed = (
        F.when(F.size(items) == 0, "message_list").when(_all(items, shop), "shop_pages").when(_all(items, crew), "crew_events").when(_all(items, graph), "graph_callbacks")
        .when(F.exists(items, lambda x: has(x, "sessionId") & has(x, "message")), "session_records").when(_all(items, is_runtime), "agent_runtime").when(F.exists(items, is_transcript), "agent_session").when(_all(items, lambda x: has(x, "role", "content")), "message_list")
        .when(_all(items, lambda x: has(x, "event_type", "type")), "event_list").when(_all(items, lambda x: has(x, "span_id", "trace_id", "name")), "spans")
    )
    return F.when(items.isNotNull(), listed).otherwise(whole)


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Rows of a trace numbered from 0 in order, with their event id."""
    at = F.row_number().over(Window.partitionBy("trace_id").orderBy(*order)) - 1
    return rows.withColumn("pos", at).withColumn("event_id", F.concat("trace_id", F.lit(":"), F.col("pos").cast("string")))


def _out(rows: DataFrame, **columns: Column) -> DataFrame:
    rows = rows.withColumns(columns)
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in EVENT])


def conversations(payloads: DataFrame) -> DataFrame:
    """Turns without the system's; a turn with ``Action:`` splits into a thought and an action, others are observations or errors."""
    rows = payloads.select("trace_id", F.posexplode(_list("payload", "conversations")).alias("turn", "m"))
    role = F.coalesce(get("m", "role", "from", "speaker"), F.lit("agent"))
    content = X.content_text(F.coalesce(*[F.try_variant_get("m", f"$.{k}", "variant") for k in ("content", "value", "text")]))
    rows = rows.select("trace_id", "turn", role.alias("agent_name"), content.alias("text")).where("lower(agent_name) <> 'system'")
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    split = F.split("text", "Action:", 2)
    acts = F.size(split) > 1
    thought, act, rest = strip(F.regexp_replace(split[0], "(?s)^(.*?)Thought:", "$1")), strip(F.get(split, F.lit(1))), strip("text")
    part = lambda when, kind, output: F.when(when & (output != ""), F.struct(kind.alias("event_type"), output.alias("output")))
    parts = F.array_compact(F.array(part(acts, F.lit("agent.step"), thought), part(acts, X.action_type(act), act), part(~acts, X.observation_type(rest), rest)))
    return _out(_numbered(rows.select("trace_id", "turn", "agent_name", F.posexplode(parts).alias("part", "e")).select("*", "e.*"), "turn", "part"))


def _items(payloads: DataFrame, path: str) -> DataFrame:
    return payloads.select("trace_id", "payload", F.posexplode(_list("payload", path)).alias("pos", "m")).withColumn("event_id", F.concat("trace_id", F.lit(":"), F.col("pos").cast("string")))


def event_list(payloads: DataFrame) -> DataFrame:
    rows = _items(payloads, "events")
    step = F.coalesce(F.when(has("m", "step_index"), F.try_variant_get("m", "$.step_index", "int")).otherwise(F.try_variant_get("m", "$.step", "int")), F.col("pos"))
    return _out(rows, pos=step, event_id=F.coalesce(get("m", "event_id", "id"), F.col("event_id")), parent_event_id=get("m", "parent_event_id", "parent_id"), event_type=X.coerce_type(get("m", "event_type", "type")), agent_name=F.coalesce(get("m", "agent_name", "agent", "role"), F.lit("agent")), output=get("m", "output", "content"), error=get("m", "error"))


def shop_pages(payloads: DataFrame) -> DataFrame:
    """Each page an observation; the task id from the first page's keys, or the tail of its URL."""
    first = _list("payload")[0]
    tail = F.nullif(F.element_at(F.split(F.rtrim(get(first, "url"), F.lit("/")), "/"), -1), F.lit(""))
    task = F.coalesce(get(first, "task_id", "item_id", "id", "asin"), tail)
    rows = payloads.select(F.concat(F.lit("webshop_"), task).alias("trace_id"), F.posexplode(_list("payload")).alias("pos", "m")).withColumn("event_id", F.concat("trace_id", F.lit(":"), F.col("pos").cast("string")))
    return _out(rows, event_type=F.lit("observation"), agent_name=F.lit("environment"), output=get("m", "content", "text", "observation"))


def spans(payloads: DataFrame) -> DataFrame:
    rows = _items(payloads, "spans")
    return _out(rows, event_id=F.coalesce(get("m", "span_id", "id"), F.col("event_id")), parent_event_id=get("m", "parent_id", "parent_span_id"), event_type=X.span_type(F.coalesce(get("m", "type", "span_type", "name"), F.lit(""))), agent_name=F.coalesce(get("m", "agent", "agent_name"), F.lit("agent")), output=get("m", "output", "result"), error=get("m", "error"))


def crew_events(payloads: DataFrame) -> DataFrame:
    return _out(_items(payloads, "events"), event_type=X.crew_type(F.coalesce(get("m", "event", "type", "name"), F.lit(""))), agent_name=F.coalesce(get("m", "agent", "agent_name", "crew"), F.lit("agent")), output=get("m", "output", "result"), error=get("m", "error", "exception"))


def graph_callbacks(payloads: DataFrame) -> DataFrame:
    rows = _items(payloads, "events")
    return _out(rows, event_id=F.coalesce(get("m", "run_id", "event_id"), F.col("event_id")), parent_event_id=get("m", "parent_run_id", "parent_event_id"), event_type=X.graph_type(F.coalesce(get("m", "event", "type", "name"), F.lit(""))), agent_name=F.coalesce(get("m", "name", "agent", "node"), F.lit("agent")), output=get("m", "outputs", "output"), error=get("m", "error"))


def unified(payloads: DataFrame) -> DataFrame:
    """Messages whose step is their index; anything else is an error, not renumbered."""
    rows = payloads.select("trace_id", F.posexplode(_list("payload", "messages")).alias("pos", "m"))
    role = F.coalesce(get("m", "role"), F.lit("assistant"))
    ok = F.coalesce((F.try_variant_get("m", "$.step", "int") == F.col("pos")) & role.isin(*ROLES), F.lit(False))
    kind = F.when(ok, F.when(role == "user", "observation").when(role == "system", "run.start").when(role == "tool", "tool.result").otherwise("agent.step")).otherwise(F.raise_error(F.lit("a message's step isn't its index, or its role is unknown")))
    return _out(rows, event_id=F.concat("trace_id", F.lit(":step"), F.col("pos").cast("string")), event_type=kind, agent_name=F.coalesce(get("m", "name"), role), output=get("m", "content"))


def _rollout(records: DataFrame) -> DataFrame:
    r = F.col("record")
    kind, inner = F.coalesce(get(r, "type"), F.lit("<missing>")), F.coalesce(get(r, "payload.type"), F.lit("<missing>"))
    role, text = F.coalesce(get(r, "payload.role"), F.lit("")), X.content_text(F.try_variant_get(r, "$.payload.content", "variant"))
    code = F.try_variant_get(r, "$.payload.exit_code", "int")
    item, note = kind == "response_item", kind == "event_msg"
    said = item & (inner == "message")
    injected = (role == "user") & text.rlike(r"^\s*<(user_instructions|environment_context)>")
    ignored = (
        F.when(kind.isin(*SILENT_RECORDS) | ~has(r, "payload"), kind).when(said & ~role.isin("user", "assistant"), F.concat(F.lit("message."), F.coalesce(F.nullif(role, F.lit("")), F.lit("missing"))))
        .when(said & (F.coalesce(text, F.lit("")) == ""), F.concat(F.lit("message."), role, F.lit(".empty"))).when(said & injected, "message.user.injected_instructions").when(said, None)
        .when(item & inner.isin("reasoning", "reasoning_summary"), inner).when(item & inner.isin(*CALLS, *OUTPUTS), None).when(item, F.concat(F.lit("response_item."), inner))
        .when(note & inner.isin("error", "exec_command_end"), None).when(note, F.concat(F.lit("event_msg."), inner)).otherwise(kind)
    )
    failed = note & (inner == "exec_command_end") & (F.coalesce(code, F.lit(0)) != 0)
    return records.select(
        "trace_id", "line", ignored.alias("ignored"), get(r, "timestamp").alias("ts"), F.coalesce(get(r, "payload.call_id"), F.when(inner.isin(*CALLS), get(r, "payload.id"))).alias("call_id"),
        F.when(said, F.when(role == "user", "observation").otherwise("llm.response")).when(item & inner.isin(*CALLS), "tool.call").when(item | failed | (inner == "exec_command_end"), "tool.result").otherwise("error").alias("event_type"),
        F.when(said, F.when(role == "user", "user").otherwise("assistant")).when(item & inner.isin(*CALLS), F.coalesce(get(r, "payload.name"), inner)).when(item, "tool").when(inner == "exec_command_end", "exec_command").otherwise("assistant").alias("agent_name"),
        F.when(said, text).when(item & inner.isin(*OUTPUTS), get(r, "payload.output")).when(note & (inner == "exec_command_end") & ~failed, get(r, "payload.aggregated_output")).alias("output"),
        F.when(failed, F.coalesce(get(r, "payload.formatted_output"), F.lit("command failed"))).when(note & (inner == "error"), get(r, "payload.message")).alias("error"),
    )


def rollout(records: DataFrame) -> DataFrame:
    """A rollout log: messages, calls, outputs, errors and ended commands. An output's parent is the last call of its id before it, else the event before it."""
    rows = _numbered(_rollout(records).where("ignored is null"), "line")
    w = Window.partitionBy("trace_id").orderBy("pos")
    call = F.last(F.when(F.col("event_type") == "tool.call", F.col("event_id")), ignorenulls=True).over(Window.partitionBy("trace_id", "call_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    linked = F.when((F.col("event_type") == "tool.result") & F.col("call_id").isNotNull(), call)
    return _out(rows, parent_event_id=F.coalesce(linked, F.lag("event_id").over(w)))


def rollout_ignored(records: DataFrame) -> DataFrame:
    """How many records of each kind a rollout log has that give no event."""
    return _rollout(records).where("ignored is not null").groupBy("trace_id", F.col("ignored").alias("kind")).agg(F.count("*").alias("n"))


def session_log(records: DataFrame) -> DataFrame:
    """A session log of user and assistant records in content blocks.

    A result's parent is the call of its id, else the last event of the parent record; an assistant's
    block hangs on the last thought or text of its message, the first one on the parent record.
    """
    r = F.col("record")
    content = F.try_variant_get(r, "$.message.content", "variant")
    blocks = F.coalesce(_list(content), F.when(F.schema_of_variant(content) == "STRING", F.array(F.parse_json(F.to_json(F.named_struct(F.lit("type"), F.lit("text"), F.lit("text"), F.try_variant_get(content, "$", "string")))))))
    rows = records.where(get(r, "type").isin("user", "assistant") & has(r, "message")).select("trace_id", "line", F.coalesce(get(r, "message.role"), get(r, "type")).alias("role"), get(r, "uuid").alias("uuid"), get(r, "parentUuid").alias("parent_uuid"), get(r, "message.id").alias("message_id"), F.posexplode(blocks).alias("block", "b"))
    kind, text = F.coalesce(get("b", "type"), F.lit("text")), F.coalesce(get("b", "text"), X.content_text(F.try_variant_get("b", "$.content", "variant")))
    user = F.col("role") == "user"
    failed = F.coalesce(F.try_variant_get("b", "$.is_error", "boolean"), F.lit(False))
    result, call, thought = user & (kind == "tool_result"), ~user & (kind == "tool_use"), ~user & (kind == "thinking")
    said = (kind == "text") | (user & ~result)
    typed = F.when(result, "tool.result").when(call, "tool.call").when(thought & get("b", "thinking").isNotNull(), "reflection").when(said & (F.trim(text) != ""), F.when(user, "observation").otherwise("llm.response"))
    rows = rows.select("*", typed.alias("event_type"), F.coalesce(F.when(call, get("b", "id")), F.when(result, get("b", "tool_use_id"))).alias("call_id"), F.when(call, F.coalesce(get("b", "name"), F.lit("tool"))).alias("tool"),
                       F.when(thought, get("b", "thinking")).when(call, None).when(~failed | ~result, text).alias("output"), F.when(result & failed, text).alias("error")).where("event_type is not null").drop("b")
    rows = _numbered(rows, "line", "block")
    last = rows.where("uuid is not null").groupBy("trace_id", F.col("uuid").alias("parent_uuid")).agg(F.max_by("event_id", "pos").alias("native"))
    rows = rows.join(last, ["trace_id", "parent_uuid"], "left")
    calls = Window.partitionBy("trace_id", "call_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    of_call = lambda c: F.when(F.col("call_id").isNotNull() & (F.col("event_type") == "tool.result"), F.last(F.when(F.col("event_type") == "tool.call", F.col(c)), ignorenulls=True).over(calls))
    message = Window.partitionBy("trace_id", F.coalesce("message_id", F.col("line").cast("string"))).orderBy("pos")
    chained = F.coalesce(F.last(F.when(F.col("event_type").isin("reflection", "llm.response"), F.col("event_id")), ignorenulls=True).over(message.rowsBetween(Window.unboundedPreceding, -1)), F.first("native").over(message))
    parent = F.when(F.col("event_type") == "tool.result", F.coalesce(of_call("event_id"), "native")).when(user, F.col("native")).otherwise(chained)
    name = F.when(F.col("event_type") == "tool.result", F.coalesce(of_call("tool"), F.lit("tool"))).when(F.col("event_type") == "tool.call", F.col("tool")).when(user, "user").otherwise("assistant")
    return _out(rows, parent_event_id=parent, agent_name=name)


def hermes(payloads: DataFrame) -> DataFrame:
    """A session export: an assistant's message gives its reasoning, its answer and a call for each tool call (a list, or JSON text of one), a tool's its result."""
    rows = payloads.select("trace_id", F.posexplode(_list("payload", "messages")).alias("at", "m"))
    role = F.coalesce(get("m", "role"), F.lit("agent"))
    content = X.content_text(F.try_variant_get("m", "$.content", "variant"))
    raw = F.try_variant_get("m", "$.tool_calls", "variant")
    calls = F.coalesce(_list(raw), _list(F.try_parse_json(F.try_variant_get(raw, "$", "string"))), F.array().cast("array<variant>"))
    part = lambda kind, name, output, error=None, call=None: F.struct(F.lit(kind).alias("event_type"), name.alias("agent_name"), output.alias("output"), (F.lit(None).cast("string") if error is None else error).alias("error"), (F.lit(None).cast("string") if call is None else call).alias("call_id"))
    null = F.lit(None).cast("string")
    some = F.coalesce(content, F.lit("")) != ""
    bad = X.looks_like_error(content)
    reasoning = get("m", "reasoning", "reasoning_content")
    assistant = F.concat(
        F.array_compact(F.array(F.when(reasoning.isNotNull(), part("reflection", F.lit("assistant"), reasoning)), F.when(some, part("llm.response", F.lit("assistant"), content)))),
        F.transform(F.filter(calls, lambda c: F.schema_of_variant(c).startswith("OBJECT")), lambda c: part("tool.call", F.coalesce(get(c, "function.name"), F.lit("tool")), null, call=get(c, "id"))),
    )
    tool = F.array(part("tool.result", get("m", "tool_name"), F.when(~bad, content), F.when(bad, content), get("m", "tool_call_id")))
    other = F.array_compact(F.array(F.when(some, part("observation", role, content))))
    parts = F.when(role == "assistant", assistant).when(role == "tool", tool).when(role != "system", other)
    rows = _numbered(rows.select("trace_id", "at", F.posexplode(parts).alias("part", "e")).select("trace_id", "at", "part", "e.*"), "at", "part")
    calls_of = Window.partitionBy("trace_id", "call_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    of_call = lambda c: F.when(F.col("call_id").isNotNull(), F.last(F.when(F.col("event_type") == "tool.call", F.col(c)), ignorenulls=True).over(calls_of))
    within = Window.partitionBy("trace_id", "at").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    chained = F.last(F.when(F.col("event_type").isin("reflection", "llm.response"), F.col("event_id")), ignorenulls=True).over(within)
    result = F.col("event_type") == "tool.result"
    rows = rows.withColumns({"of_name": of_call("agent_name"), "parent_event_id": F.when(result, of_call("event_id")).when(F.col("event_type").isin("llm.response", "tool.call"), chained)})
    return _out(rows, agent_name=F.when(result, F.coalesce("agent_name", "of_name", F.lit("tool"))).otherwise(F.col("agent_name")))


def answer_steps(payloads: DataFrame) -> DataFrame:
    """A question-answering run: its start, an event per stringified message (what can't be read is an observation as it stands), its end."""
    step = F.expr("try_variant_get(m, '$', 'string')")
    role = F.nullif(F.regexp_extract(step, r"role=<[^:>]*: '([a-z\-]+)'", 1), F.lit(""))
    body = F.nullif(F.array_join(F.regexp_extract_all(step, F.lit(r"'text': '((?:[^'\\]|\\.)*)'"), F.lit(1)), "\n"), F.lit(""))
    read = role.isNotNull() & body.isNotNull()
    body = F.replace(F.replace(body, F.lit("\\n"), F.lit("\n")), F.lit("\\'"), F.lit("'"))
    response = F.when(role == "tool-response", F.lower(body).rlike("traceback|exception|error:"))
    steps = payloads.select("trace_id", F.posexplode(_list("payload", "intermediate_steps")).alias("at", "m"))
    kind = F.when(~read, "observation").when(role == "tool-call", "tool.call").when(role == "tool-response", "tool.result").when(role == "assistant", "llm.response").otherwise("observation")
    middle = steps.select("trace_id", (F.col("at") + 1).alias("at"), kind.alias("event_type"), F.when(read, role).otherwise("environment").alias("agent_name"), F.when(~read, step).when(~F.coalesce(response, F.lit(False)), body).alias("output"), F.when(response, body).alias("error"))
    edge = lambda at, kind, key: payloads.select("trace_id", at.cast("int").alias("at"), F.lit(kind).alias("event_type"), F.lit("system").alias("agent_name"), get("payload", key).alias("output"), F.lit(None).cast("string").alias("error"))
    size = F.size(_list("payload", "intermediate_steps")) + 1
    return _out(_numbered(edge(F.lit(0), "run.start", "task").unionByName(middle).unionByName(edge(size, "run.end", "prediction")), "at"))


def benchmark_rows(lines: DataFrame) -> DataFrame:
    """``(index, value)`` lines of a benchmark file: the trajectory is JSON in a string (else one assistant message); events at the critical step and the one before it carry the failure."""
    p = F.col("p")
    rows = lines.select("index", "value", F.try_parse_json("value").alias("p")).where("p is not null")
    inner = F.try_parse_json(get(p, "full_trajectory"))
    messages = F.coalesce(_list(inner, "messages"), _list(inner), F.array(F.parse_json(F.to_json(F.named_struct(F.lit("role"), F.lit("assistant"), F.lit("content"), get(p, "full_trajectory"))))))
    trace = X.stable_trace_id(get(p, "trace_id", "trajectory_id", "task_id", "id"), F.col("value"), F.col("index"))
    gold = F.try_variant_get(p, "$.critical_failure_step", "int")
    why = F.coalesce(F.get(F.try_variant_get(p, "$.failure_reasonings", "array<string>"), F.lit(0)), F.concat(F.lit("critical failure: module="), F.coalesce(get(p, "critical_failure_module"), F.lit("unknown")), F.lit("; types="), F.coalesce(F.nullif(F.array_join(F.try_variant_get(p, "$.failure_types", "array<string>"), ","), F.lit("")), F.lit("unlabeled"))))
    rows = rows.select(trace.alias("trace_id"), gold.alias("gold"), why.alias("why"), F.posexplode(messages).alias("pos", "m"))
    role = F.lower(F.coalesce(get("m", "role"), F.lit("agent")))
    kind = F.when(role.isin("user", "human"), "observation").when(role == "system", "run.start").when(role.isin("tool", "function"), "tool.result").otherwise("agent.step")
    marked = F.col("pos").isin(F.col("gold"), F.col("gold") - 1)
    return _out(rows, event_id=F.concat("trace_id", F.lit("_evt_"), F.lpad((F.col("pos") + 1).cast("string"), 3, "0")), event_type=kind, agent_name=role, output=X.content_text(F.try_variant_get("m", "$.content", "variant")), error=F.coalesce(get("m", "error"), F.when(marked, F.col("why"))))


def upload_split(texts: DataFrame) -> DataFrame:
    """``(upload_id, text)`` to payloads: an object, a list of messages (one payload), a list of payloads, or lines of JSON; ``error`` where a piece doesn't parse."""
    # the parser stops at the end of the first value, so what follows it would be lost: as a list it has to be one item
    wrapped = _list(F.try_parse_json(F.concat(F.lit("["), "text", F.lit("]"))))
    whole = F.when(F.size(wrapped) == 1, wrapped[0])
    items = _list(whole)
    messages = _all(items, lambda x: has(x, "role") & has(x, "content"))
    lines = F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), lambda x: F.struct(F.try_parse_json(x).alias("payload"), F.try_parse_json(x).isNull().alias("error")))
    one = lambda v: F.struct(v.alias("payload"), F.lit(False).alias("error"))
    pieces = F.when(whole.isNull(), lines).when(items.isNotNull() & ~messages, F.transform(items, one)).otherwise(F.array(one(whole)))
    return texts.select("upload_id", F.posexplode(pieces).alias("piece", "x")).select("upload_id", "piece", "x.*")
