"""Budgeted views against the plain loop, mended JSON at every cut, and folders of mixed files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tracelake.functions import repair
from tracelake.operators import assembly
from tracelake.sources import folders


def plain(blocks, focus, cap):
    """blocks: {pos: (full, brief or None)}: what is shown, and how many are dropped."""
    shown, brief = {p: f for p, (f, _) in blocks.items()}, {p: b for p, (_, b) in blocks.items()}
    dropped = 0
    at = focus if focus is not None else max(shown)
    while sum(map(len, shown.values())) + 2 * (len(shown) - 1) > cap and len(shown) > 1:
        p = min((p for p in shown if p != focus), key=lambda p: (-abs(p - at), p))
        if brief[p] is not None:
            shown[p], brief[p] = brief[p], None
        else:
            del shown[p]
            dropped += 1
    return "\n\n".join(shown[p] for p in sorted(shown)) + (f"\n\n--- {dropped} more step(s) omitted to fit the context budget ---" if dropped else ""), dropped


@pytest.mark.parametrize("cap", [0, 20, 60, 150, 10_000])
def test_views_fit_like_the_plain_loop(spark, cap):
    rng = random.Random(cap)
    views, rows = {}, []
    for v in range(60):
        n = rng.randrange(1, 14)
        positions = rng.sample(range(40), n)
        focus = rng.choice([None, rng.choice(positions), 20])
        blocks = {p: ("f" * rng.randrange(0, 30), None if rng.random() < 0.3 else "b" * rng.randrange(0, 12)) for p in positions}
        views[f"t{v}"] = plain(blocks, focus, cap)
        rows += [(f"t{v}", focus, p, f, b, "x") for p, (f, b) in blocks.items()]
    df = spark.createDataFrame(rows, "trace_id string, focus int, pos int, full string, brief string, n string").drop("n")
    got = assembly.assemble(df, cap).collect()
    assert {r.trace_id: (r.text, r.dropped) for r in got} == views
    assert assembly.assemble(df.limit(0), cap).count() == 0


def test_json_cut_at_every_byte():
    """What a cut payload is mended to: a prefix of its values, closed; never anything that wasn't there."""
    whole = {"a": [1, {"b": "x, \"]}\\"}, [2, 3]], "c": {"d": None, "e": "é\n"}, "f": [[], {}]}
    text = json.dumps(whole, ensure_ascii=False)

    def within(small, big):
        if isinstance(small, dict):
            return isinstance(big, dict) and all(k in big and within(v, big[k]) for k, v in small.items())
        if isinstance(small, list):
            return isinstance(big, list) and len(small) <= len(big) and all(within(a, b) for a, b in zip(small, big, strict=False))
        return small == big

    sizes = []
    for cut in range(len(text) + 1):
        got = repair.lenient(text[:cut])
        if got is not None:
            assert within(json.loads(got), whole), cut
            sizes.append(len(got))
    assert len(sizes) > 0.8 * len(text) and json.loads(repair.lenient(text)) == whole and sizes == sorted(sizes)


LITERAL = [
    ('{"a": 1', None), ('{"a": 1, "b": [1, 2', {"a": 1, "b": [1]}), ('```json\n{"a": "line\nbreak"}\n```', {"a": "line\nbreak"}), ("so: {\"a\": {\"b\": 2}, \"c\": \"unfin", {"a": {"b": 2}}),
    ("no object", None), ("[1, 2]", None), (None, None), ("", None), ('{"a": "}', None), ('{', {}), ('text {"a": 1} more {"b": 2}', None), ('{"a": 1}', {"a": 1}), ('{"a": 1,', None),
]


def test_literal_answers(spark):
    want = {t: o for t, o in LITERAL}
    # a number that breaks off may be the start of another one: it goes with its comma
    want['{"a": 1'], want['{"a": 1,'] = {"a": 1}, {"a": 1}
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LITERAL)], "i int, t string")
    got = rows.select("i", F.to_json(repair.lenient_object(F.col("t"))).alias("j")).collect()
    assert {LITERAL[r.i][0]: None if r.j is None else json.loads(r.j) for r in got} == want


def test_a_folder_of_mixed_files(spark, tmp_path):
    deep = tmp_path / "in" / "deep"
    deep.mkdir(parents=True)
    put = lambda name, *values: (tmp_path / "in" / name).write_text("\n".join(v if isinstance(v, str) else json.dumps(v) for v in values))
    put("chat.json", json.dumps({"trace_id": "t1", "messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]}, indent=1))
    put("deep/chat.jsonl", {"role": "user", "content": "a"}, "", {"role": "tool", "content": "b"})
    put("spans.jsonl", {"span_id": "s1", "name": "tool_call", "result": "r"}, {"span_id": "s2", "parent_id": "s1", "name": "generation"})
    put("rollout.jsonl", {"type": "session_meta", "payload": {}}, {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "go"}]}})
    put("session.jsonl", {"type": "summary"}, {"type": "user", "sessionId": "x", "uuid": "u1", "message": {"role": "user", "content": "do it"}})
    put("events.json", [{"event_type": "tool.call", "output": "o"}])
    put("broken.jsonl", {"role": "user"}, "{nope")
    put("odd.json", {"what": 1})
    put("empty.json", " ", "")
    put("notes.txt", "not looked at")
    events, files = folders.read_folder(spark, f"file://{tmp_path}/in")
    told = {r.file.rpartition("/in/")[2]: (r.format, r.error) for r in files.collect()}
    assert told == {
        "chat.json": ("messages", None), "deep/chat.jsonl": ("message_list", None), "spans.jsonl": ("spans", None), "rollout.jsonl": ("rollout", None), "session.jsonl": ("session_records", None),
        "events.json": ("event_list", None), "broken.jsonl": (None, "line 2 is not JSON"), "odd.json": (None, "no known format"), "empty.json": (None, "no values"),
    }
    got = [(r.format, r.trace_id, r.pos, r.event_type, r.output) for r in events.collect()]
    assert sorted(got, key=str) == sorted([
        ("messages", "t1", 0, "observation", "hi"), ("messages", "t1", 1, "agent.step", "yo"), ("message_list", "chat", 0, "observation", "a"), ("message_list", "chat", 1, "tool.result", "b"), ("spans", "spans", 0, "tool.call", "r"),
        ("spans", "spans", 1, "llm.call", None), ("rollout", "rollout", 0, "observation", "go"), ("session_records", "session", 0, "observation", "do it"), ("event_list", "events", 0, "tool.call", "o"),
    ], key=str)
    assert [r.parent_event_id for r in events.where("format = 'spans' and pos = 1").collect()] == ["s1"]


def test_narrowing(spark):
    runs = spark.createDataFrame([("a", i) for i in range(10)] + [("b", i * 2) for i in range(4)] + [("c", 5), ("d", None)] + [("e", i) for i in range(10)], "trace_id string, step_index int")
    answers = spark.createDataFrame(
        [("a", 0, 9, "upper", 0.9), ("a", 0, 4, "Lower ", 0.8), ("a", 3, 4, "upper", 0.1), ("b", 0, 6, "lower", 0.2), ("e", 0, 9, "?", 0.9)], "trace_id string, low int, high int, half string, confidence double"
    )
    picks = spark.createDataFrame([("b", 6), ("e", 99)], "trace_id string, step int")
    got = {r.trace_id: tuple(r)[1:] for r in assembly.narrow(runs, answers, picks, window=2).collect()}
    # a first answer that says nothing leaves the confidence as it was, so it is asked once more
    assert got == {"a": (3, 3, 3, 3, "refined"), "b": (6, 4, 6, 1, "picked"), "c": (5, 5, 5, 0, "single"), "e": (0, 0, 9, 2, "refined")}
    cascade = {r.trace_id: tuple(r)[1:] for r in assembly.narrow(runs, answers, picks, window=2, floor=None, rounds=1).collect()}
    assert cascade == {"a": (0, 0, 4, 1, "fallback"), "b": (6, 4, 6, 1, "picked"), "c": (5, 5, 5, 0, "single"), "e": (0, 0, 9, 1, "fallback")}
