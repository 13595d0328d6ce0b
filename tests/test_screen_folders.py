"""Folders of screen runs from disk, and rerun requests: literal cases."""

import json

from pyspark.sql import functions as F

from tracelake.operators import rerun
from tracelake.sources import screen_runs


def write(folder, **files):
    for name, value in files.items():
        at = folder / name.replace("__", "/").replace("_dot_", ".")
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(value if isinstance(value, str) else "\n".join(r if isinstance(r, str) else json.dumps(r) for r in value))


def test_folders_of_runs(spark, tmp_path):
    acts = [
        {"step_num": 2, "action": {"action_type": "key", "command": "", "raw_response": "[TEXT] so\n[TOOL_USE] a \n[TEXT] then [TOOL_USE] b"}, "screenshot_file": "gone.png", "done": True, "reward": 1},
        "{broken",
        {"step_num": 1, "action": {"command": "click(1)"}, "response": "The user wants me to  open   it. Now", "screenshot_file": "s1.png", "info": {"error": " no "}},
        {"Error": "crash"},
        "[1]",
        "",
    ]
    texts = [{"step_num": 3, "action": "type x", "response": "hm <tool_call><function=f><parameter=p> 1 </parameter></function></tool_call>", "full_plan": "hm", "reflection": "r", "action_timestamp": "t9"}, {"action": None, "info": "none"}]
    write(tmp_path / "in", web__A__traj_dot_jsonl=acts, web__A__trajectory_dot_jsonl=[{"step_num": 9}], web__A__result_dot_txt=" 1\n", web__A__s1_dot_png="x", B__trajectory_dot_jsonl=texts, B__B_dot_json='{"instruction":"Sort.","id":"b-1","evaluator":{"func":"infeasible"}}', B__result_dot_txt="n/a", B__screenshots__step_3_t9_dot_png="x", C__traj_dot_jsonl="", D__note_dot_json="{}")
    t = screen_runs.read(spark, f"file://{tmp_path}/in")
    got = [(r.trace_id, r.pos, r.step_index, r.reasoning, r.tool_use, r.output, r.error, r.reward, r.done, r.action_type, (r.screenshot or "").rpartition("/in/")[2]) for r in screen_runs.events(t).orderBy("run", "pos").collect()]
    assert got == [
        ("osworld_b-1", 0, 0, None, None, None, None, 0.0, False, "code", ""),
        ("osworld_b-1", 1, 3, "Model response:\nhm\n\nReflection:\nr", "function: f\np: 1", "type x", None, 0.0, False, "code", "B/screenshots/step_3_t9.png"),
        ("osworld_A", 0, 1, "The user wants me to  open   it. Now", None, "click(1)", "no", 0.0, False, "tool_use", "web/A/s1.png"),
        ("osworld_A", 1, 2, "[TEXT] so\n[TEXT] then", "a\n\nb", "key", None, 1.0, True, "key", ""),
    ]
    runs = {r.task_id: (r.goal, r.format, r.score, r.is_infeasible, r.status, r.terminal_step, r.error) for r in screen_runs.runs(t).collect()}
    assert runs["A"] == ("Open it.", "claude", 1.0, False, "success", 2, "") and runs["b-1"][:5] == ("Sort.", "legacy", None, True, "failure")


def test_requests(spark):
    reports = spark.createDataFrame(
        [("a", "1", "e2", 9, None, ["s1", "s2"]), ("b", "2", "zz", 5, '{"proposals":[{"suggestion_text":"do","requires_human_approval":false}]}', None), ("c", "3", "x", 7, "[]", []), ("d", "4", None, None, None, None)],
        "trace_id string, report_id string, root_event_id string, root_step_index int, recovery string, suggestions array<string>",
    ).withColumn("recovery", F.try_parse_json("recovery"))
    runs = spark.createDataFrame([("a", "e1", 0, 0), ("a", "e2", 1, 4), ("a", "e2", 2, 5), ("b", "f1", 0, 5), ("b", "f2", 1, 5), ("d", "g1", 0, None), ("d", "g2", 1, 2)], "trace_id string, event_id string, pos int, step_index int")
    found = spark.createDataFrame([("d", 0, "none", ""), ("d", 1, "g2", "last"), ("d", 2, "g1", "more")], "trace_id string, ordinal int, event_id string, suggestion string")
    take = lambda df: {r.trace_id: (r.event_id, r.step_index, r.directive, r.target_event_id, r.needs_approval, r.n_findings, r.n_suggestions, r.error) for r in df.collect()}
    root = take(rerun.requests(reports, runs, found))
    assert root == {"a": ("e2", 4, "s1", "e2", True, 0, 2, None), "b": ("f1", 5, "do", "f1", False, 0, 0, None), "c": ("x", 7, rerun.NO_DIRECTIVE, "x", True, 0, 0, None), "d": ("g2", 2, "last", "g2", True, 3, 0, None)}
    chosen = spark.createDataFrame([("a", "e1"), ("b", "no"), ("c", "no")], "trace_id string, event_id string")
    got = take(rerun.requests(reports, runs, found, chosen=chosen))
    assert (got["a"][:2], got["b"][7], got["c"][:2], got["c"][7], got["d"][0]) == (("e1", 0), "unknown checkpoint event: no", ("x", 7), None, "g2")
    start = take(rerun.requests(reports, runs, found, from_start=True))
    assert [start[k][:2] + start[k][3:4] for k in "abcd"] == [(None, None, "e2"), (None, None, "zz"), (None, None, "x"), (None, None, None)]
    assert rerun.requests(reports.limit(0), runs, found).count() == 0


def test_capability(spark):
    rows = spark.createDataFrame([(None, None), ('{"replay_bundle":3}', "simulated_rollout"), ('{"replay_bundle":{"environment_snapshot":{"a":1}}}', "odd")], "v string, mode string").withColumn("m", F.try_parse_json("v"))
    got = [tuple(r.c) for r in rows.select(rerun.capability(F.col("m"), F.col("mode")).alias("c")).collect()]
    every = ["framework_runner", "tool_runtime", "environment_state"]
    assert got == [("trajectory_only", False, every, ["diagnostic_report"]), ("trajectory_only", False, every, ["diagnostic_report", "trajectory"]), ("replay_bundle", False, every[:2], ["diagnostic_report", "trajectory", "replay_bundle", "environment_snapshot"])]
