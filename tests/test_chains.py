"""Parent chains: long ones, circles, parents that aren't there; quotes and blames on literal rows."""

from tracelake.operators import blame, context, screens


def test_nearest_kept_walks_long_chains_and_stands_circles(spark):
    rows = [("t", f"e{i:03}", f"e{i - 1:03}" if i else None, i in (0, 150, 299)) for i in range(300)]
    rows += [("t", "x", "y", False), ("t", "y", "x", False), ("t", "z", "x", True), ("u", "e000", "missing", True)]
    got = {(r.trace_id, r.event_id): r.kept_parent for r in context.nearest_kept(spark.createDataFrame(rows, "trace_id string, event_id string, parent_id string, kept boolean"), depth=1 << 10).collect()}
    assert got == {("t", "e000"): None, ("t", "e150"): "e000", ("t", "e299"): "e150", ("t", "z"): None, ("u", "e000"): None}


def test_cascade_goes_depth_first_and_lists_leftovers_last(spark):
    rows = [("t", "root", None, 1), ("t", "late", "root", 9), ("t", "soon", "root", 2), ("t", "leaf", "soon", 5), ("t", "a", "b", 3), ("t", "b", "a", 4), ("t", "lost", "gone", 0)]
    rows += [("c", f"n{i:02}", f"n{i - 1:02}" if i else None, i) for i in range(70)]
    got = screens.cascade(spark.createDataFrame(rows, "trace_id string, event_id string, parent_id string, step int"), depth=128).orderBy("trace_id", "place").collect()
    assert [(r.event_id, r.depth) for r in got if r.trace_id == "t"] == [("root", 0), ("soon", 1), ("leaf", 2), ("late", 1), ("lost", None), ("a", None), ("b", None)]
    assert [(r.event_id, r.depth) for r in got if r.trace_id == "c"] == [(f"n{i:02}", i) for i in range(70)]


RUN = "trace_id string, event_id string, pos int, step_index int, agent_name string, event_type string, text string"


def test_ambiguous_steps_are_not_guessed(spark):
    runs = spark.createDataFrame([("t", "e0", 0, 0, "A", "agent.step", ""), ("t", "e1", 1, 0, "B", "agent.step", ""), ("t", "e2", 2, 1, "A", "agent.step", "")], RUN)
    blames = spark.createDataFrame([("t", "1", None, 0, None), ("t", "2", None, 0, "b (x)"), ("t", "3", None, 1, None), ("t", "4", "e0", 1, None), ("t", "5", "nope", None, None)], "trace_id string, blame_id string, span_id string, step int, agent string")
    got = {r.blame_id: r.event_id for r in blame.resolve_candidate(blames, runs).collect()}
    assert got == {"1": None, "2": "e1", "3": "e2", "4": "e2", "5": None}
    assert {r.blame_id: r.event_id for r in blame.blamed_event(blames, runs).collect()}["1"] == "e0"


def test_quotes_are_three_valued(spark):
    runs = spark.createDataFrame([("t", "e0", 0, 0, "A", "observation", "The door is  locked"), ("t", "e1", 1, 1, "A", "agent.step", 'I open the "door"'), ("t", "e2", 2, 2, "A", "observation", "later text")], RUN)
    goals = spark.createDataFrame([("t", "leave the room")], "trace_id string, goal string")
    rows = [("t", "ok", "e1", 'open the \\"door\\" ...', "door is locked", "context"), ("t", "wrong step", "e0", "open the", None, None), ("t", "none", "e1", None, None, None), ("t", "goal", "e1", None, "leave the room", "task"), ("t", "no goal", "e1", None, "leave the room", "env"), ("t", "later", "e1", None, "later text", "self"), ("t", "own", "e1", None, "I open", "self")]
    scope = {"context": ("observation",), "env": ("observation",), "self": ("plan",), "task": ("run.start",)}
    got = {r.finding_id: r.quote_verified for r in context.verify_quotes(spark.createDataFrame(rows, "trace_id string, finding_id string, event_id string, wrong string, reference string, axis string"), runs, scope, goals).collect()}
    assert got == {"ok": True, "wrong step": False, "none": None, "goal": True, "no goal": False, "later": False, "own": True}
