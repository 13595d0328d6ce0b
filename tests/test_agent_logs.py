"""An agent host's transcript and runtime log: literal records, awkward rows, and both in a folder."""

import json
import os

from tracelake.sources import agent_logs, exports, folders

MESSAGE = "trace_id string, line long, value string"


def records(spark, rows):
    from pyspark.sql import functions as F

    made = [(t, i, None if r is None else r if isinstance(r, str) else json.dumps(r)) for t, i, r in rows]
    return spark.createDataFrame(made, MESSAGE).select("trace_id", "line", F.try_parse_json("value").alias("record"))


def said(role, *blocks, **more):
    return {"type": "message", **more.pop("of", {}), "message": {"role": role, "content": blocks[0] if blocks and isinstance(blocks[0], str) else list(blocks), **more}}


TRANSCRIPT = [
    {"type": "session", "id": "S1", "version": 3, "cwd": "/w", "timestamp": 1714557600000},
    said("user", "  fix it ", of={"id": "m1"}),
    said("assistant", {"type": "reasoning", "text": "hm"}, {"type": "toolUse", "id": "k1", "name": "ls", "arguments": {}}, of={"id": "m2", "parentId": "m1"}),
    {"type": "session-meta", "agentId": "fixer"},
    said("toolResult", {"type": "text", "text": "no such file"}, of={"id": "m3", "parentId": "m1"}, toolCallId="k1", isError=True),
    said("assistant", {"type": "text", "text": "   "}, {"type": "text", "text": "done"}, {"type": "chart"}, of={"id": "m4", "parentId": "m3"}),
    said("user", {"type": "tool_result", "tool_use_id": "k1", "content": [{"text": "a"}, "b", 3]}, {"type": "tool_result", "tool_use_id": "k9", "name": "cat", "is_error": True}, of={"id": "m5", "parentId": "m5"}),
    {"type": "custom", "customType": "note"},
    said("assistant", {"type": "tool_use", "id": "k1", "name": "rm"}, of={"id": "m1", "parentId": "m9"}),
    said("critic", "late", of={"parent_id": "m1"}),
    said("toolResult", "ok", tool_call_id="k1"),
]


def test_transcript(spark):
    got = agent_logs.session_events(records(spark, [("f", i, r) for i, r in enumerate(TRANSCRIPT)])).orderBy("pos").collect()
    assert [tuple(r)[1:] for r in got] == [
        (0, "f:0", None, "observation", "user", "  fix it ", None),
        (1, "f:1", "f:0", "reflection", "openclaw-agent", "hm", None),
        (2, "f:2", "f:0", "tool.call", "ls", None, None),
        (3, "f:3", "f:2", "tool.result", "ls", None, "no such file"),  # its call goes before its record's parent
        (4, "f:4", "f:3", "llm.response", "fixer", "done", None),
        (5, "f:5", "f:2", "tool.result", "ls", "a\nb", None),
        (6, "f:6", None, "tool.result", "cat", None, None),  # a record is not its own parent, and an error without text has none
        (7, "f:7", None, "tool.call", "rm", None, None),
        (8, "f:8", "f:7", "observation", "critic", "late", None),  # the last message of that id
        (9, "f:9", "f:7", "tool.result", "rm", "ok", None),  # the last call of that id
    ]
    run = agent_logs.session_runs(records(spark, [("f", i, r) for i, r in enumerate(TRANSCRIPT)])).collect()
    assert [(r.session_id, r.version, r.folder, str(r.started_at), r.agent, r.goal, r.n_custom, r.n_unknown_blocks, r.has_header) for r in run] == [("S1", "3", "/w", "2024-05-01 10:00:00", "fixer", "fix it", 1, 1, True)]


def test_transcript_awkward_rows(spark):
    rows = [("a", 0, None), ("a", 1, "[1]"), ("a", 2, '{"type":"message","message":"x"}'), ("a", 3, '{"type":"message","message":{"content":7}}'), ("a", 4, said("user")), ("a", 5, said("user", "x" * 200_000)), ("b", 0, said("assistant", {"type": "tool_use"}, {"type": "toolResult"}))]
    got = {(r.trace_id, r.pos): r for r in agent_logs.session_events(records(spark, rows)).collect()}
    assert sorted(got) == [("a", 0), ("b", 0), ("b", 1)] and len(got["a", 0].output) == 200_000
    assert (got["b", 0].agent_name, got["b", 1].agent_name, got["b", 1].parent_event_id) == ("tool", "tool", None)
    runs = {r.trace_id: (r.has_header, r.agent, r.n_unknown_blocks) for r in agent_logs.session_runs(records(spark, rows)).collect()}
    assert runs == {"a": (False, "openclaw-agent", 0), "b": (False, "openclaw-agent", 0)}
    none = records(spark, [])
    assert agent_logs.session_events(none).count() == agent_logs.session_runs(none).count() == agent_logs.runtime_events(none).count() == agent_logs.runtime_runs(none).count() == 0


def typed(kind, data=None, **more):
    return {"traceSchema": "openclaw-trajectory", "traceId": "T7", "sessionId": "S7", "sessionKey": "agent:main:ann", "type": kind, "data": data, **more}


RUNTIME = [
    typed("model.completed", {"assistantTexts": ["", " "], "messagesSnapshot": [{"role": "assistant", "content": "old"}, {"role": "assistant", "content": [{"type": "text", "text": "new"}]}, {"role": "assistant", "content": ""}, {"role": "user", "content": "q"}]}),
    typed("session.started", {}, sessionKey="bob", ts="2024-05-01T10:00:00Z"),
    typed("prompt.submitted", {"prompt": " go "}),
    typed("tool.call", {"toolCallId": "k", "name": "web"}),
    typed("tool.result", {"toolCallId": "k", "name": "web", "success": False, "contentItems": ["e1", {"content": "e2"}, {}]}),
    typed("tool.result", {"toolCallId": "z", "contentItems": "plain"}),
    typed("model.completed", {"assistantTexts": ["x", "y", 3]}),
    typed("context.compiled", {}),
    typed("odd"),
    typed("session.ended", {"status": "ok", "timedOut": True}, ts=1714557660),
]


def test_runtime(spark):
    rows = records(spark, [("f", i, r) for i, r in enumerate(RUNTIME)] + [("f", 99, None)])
    got = agent_logs.runtime_events(rows).orderBy("pos").collect()
    assert [tuple(r)[3:] for r in got] == [
        (None, "llm.response", "ann", "new", None), (None, "observation", "user", " go ", None), (None, "tool.call", "web", None, None), ("f:2", "tool.result", "web", None, "e1\ne2"),
        (None, "tool.result", "tool", "plain", None), (None, "llm.response", "bob", "x\ny", None),
    ]
    run = agent_logs.runtime_runs(rows).collect()[0]
    assert (run.session_id, str(run.started_at), str(run.ended_at), run.status, run.timed_out, run.goal, run.n_unknown) == ("S7", "2024-05-01 10:00:00", "2024-05-01 10:01:00", "ok", True, "go", 1)


def test_both_in_a_folder(spark, tmp_path):
    for name, rows, listed in (("s.jsonl", TRANSCRIPT, False), ("t.json", RUNTIME, True), ("one.jsonl", [said("user", "hi")], False)):
        os.makedirs(tmp_path / "in", exist_ok=True)
        (tmp_path / "in" / name).write_text(json.dumps(rows) if listed else "\n".join(map(json.dumps, rows)))
    events, files = folders.read_folder(spark, f"file://{tmp_path}/in")
    assert {r.file.rpartition("/")[2]: (r.format, r.error) for r in files.collect()} == {"s.jsonl": ("agent_session", None), "t.json": ("agent_runtime", None), "one.jsonl": ("agent_session", None)}
    counts = {(r.format, r.trace_id): r["count"] for r in events.groupBy("format", "trace_id").count().collect()}
    assert counts == {("agent_session", "S1"): 10, ("agent_runtime", "T7"): 6, ("agent_session", "one"): 1}


def test_detection_of_lists(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, json.dumps(TRANSCRIPT)), (2, json.dumps(RUNTIME)), (3, json.dumps([*RUNTIME, {"type": "x"}])), (4, json.dumps([{"type": "session", "id": 5}]))], "i int, v string")
    got = rows.select("i", F.parse_json("v").alias("payload")).select("i", exports.detect_format().alias("f"))
    assert {r.i: r.f for r in got.collect()} == {1: "agent_session", 2: "agent_runtime", 3: "event_list", 4: "event_list"}
