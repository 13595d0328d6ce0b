"""Queries of screen-run folders and of rerun requests, over views of the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rerun
from ..sources import screen_runs
from ..sources.fixtures import EVT_SQL, event_runs, table
from .imports import NS, NULLS, C, L
from .registry import query

# --- a folder per conversation: even ones with object actions, odd ones with text; a turn is a step, counted backwards


def _run_tables(spark: SparkSession, sf_dir: str) -> screen_runs.Tables:
    rows = table(spark, sf_dir, "conversations").withColumns({"even": C("conv_id") % 2 == 0, "run": F.concat(L("in/web/"), C("conv_id").cast("string")), "step": L(20) - C("turn")})
    shared = {"step_num": C("step"), "done": C("turn") == 0, "reward": C("turn") % 3, "info": NS(L("error"), F.when(C("turn") % 4 == 3, L(" late "))), "response": C("text")}
    struct = lambda **x: F.to_json(F.struct(*[v.alias(k) for k, v in x.items()]))
    action = NS(L("action_type"), L("click"), L("command"), F.when(C("turn") % 2 == 0, F.concat(L("go "), C("role"))), L("raw_response"), F.concat(L("[THINKING] "), C("role"), L("\n[TOOL_USE] press")))
    acted = struct(**shared, action=action, screenshot_file=F.concat(L("s"), C("turn").cast("string"), L(".png")))
    typed = struct(**shared, action=F.concat(L("type "), C("role")), full_plan=C("text"), reflection=L("The user wants me to   sort it. Then"), action_timestamp=L("t"))
    value = F.when(C("turn") == 5, struct(Error=L("boom"))).when(C("even"), acted).otherwise(typed)
    lines = rows.select("run", F.when(C("even"), "traj.jsonl").otherwise("trajectory.jsonl").alias("name"), C("turn").alias("line"), value.alias("value"))
    each = rows.select("conv_id", "run").distinct()
    configs = each.where("conv_id % 4 = 1").select("run", F.concat(L('{"instruction":"Do it.","evaluator":{"func":"infeasible"},"id":"t'), C("conv_id").cast("string"), L('"}')).alias("value"))
    results = each.where("conv_id % 3 < 2").select("run", F.when(C("conv_id") % 3 == 0, " 1.0\n").otherwise("none").alias("value"))
    shot = F.when(C("even"), F.concat(L("s"), C("turn").cast("string"), L(".png"))).otherwise(F.concat(L("screenshots/step_"), C("step").cast("string"), L("_t.png")))
    return screen_runs.Tables(lines, configs, results, rows.where("turn % 2 = 0").select(F.concat("run", L("/"), shot).alias("path")))


_RUNS = "WITH t AS (SELECT *, conv_id % 2 = 0 AS even, concat('in/web/', conv_id) AS run, CASE WHEN conv_id % 4 = 1 THEN concat('t', conv_id) ELSE conv_id::VARCHAR END AS task, 20 - turn AS step, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS i FROM conversations WHERE turn <> 5)"
query(
    "screen_folder_events",
    _RUNS + """ SELECT run, concat('osworld_', task) AS trace_id, cast(i AS int) AS pos, concat('osworld_', task, ':', i) AS event_id, 'agent.step' AS event_type, cast(step AS int) AS step_index, CASE WHEN even THEN concat('[THINKING] ', role) ELSE concat(CASE WHEN trim(text) <> '' THEN concat('Model response:', chr(10), trim(text), chr(10), chr(10)) ELSE '' END, 'Reflection:', chr(10), 'The user wants me to   sort it. Then') END AS reasoning,
 CASE WHEN even THEN 'press' END AS tool_use, CASE WHEN NOT even THEN concat('type ', role) WHEN turn % 2 = 0 THEN concat('go ', role) ELSE 'click' END AS output, CASE WHEN turn % 4 = 3 THEN 'late' END AS error, cast(turn % 3 AS double) AS reward, turn = 0 AS done, CASE WHEN even THEN 'click' ELSE 'code' END AS action_type, CASE WHEN turn % 2 = 0 THEN concat(run, '/', CASE WHEN even THEN concat('s', turn, '.png') ELSE concat('screenshots/step_', step, '_t.png') END) END AS screenshot FROM t""",
)(lambda s, d: screen_runs.events(_run_tables(s, d)))
query(
    "screen_folder_runs",
    _RUNS + """, a AS (SELECT conv_id, bool_or(turn = 5) AS boom, bool_or(turn <> 5) AS stepped, bool_or(turn <> 5 AND conv_id % 2 = 1) AS told FROM conversations GROUP BY 1), l AS (SELECT conv_id, run, task, even, step, turn FROM t QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY step DESC) = 1)
SELECT run, concat('osworld_', task) AS trace_id, task AS task_id, CASE WHEN conv_id % 4 = 1 THEN 'Do it.' WHEN told THEN 'Sort it.' END AS goal, CASE WHEN even THEN 'claude' ELSE 'legacy' END AS format, CASE WHEN conv_id % 3 = 0 THEN 1.0::DOUBLE END AS score, CASE WHEN conv_id % 4 = 1 THEN 'infeasible' ELSE '' END AS evaluator, conv_id % 4 = 1 AS is_infeasible,
 CASE WHEN turn = 0 AND turn % 3 > 0 THEN 'success' ELSE 'failure' END AS status, cast(step AS int) AS terminal_step, CASE WHEN turn % 4 = 3 THEN 'late' WHEN boom THEN 'boom' WHEN turn > 0 THEN concat('trajectory terminated without done=True at step ', step) ELSE concat('task scored reward=0.0 at step ', step) END AS error FROM l JOIN a USING (conv_id)""",
)(lambda s, d: screen_runs.runs(_run_tables(s, d)))

# --- rerun requests: a report a run; its root is an event, a step, a finding's event, or nothing


def _reports(runs: DataFrame) -> DataFrame:
    k = F.substring("trace_id", 2, 20).cast("long") % 5
    rows = runs.groupBy("trace_id").agg(F.max_by("event_id", "pos").alias("last")).withColumn("k", k)
    recovery = F.when(C("k") == 0, '{"proposals":[{"suggestion_text":"use less","requires_human_approval":false}]}').when(C("k") == 1, '{"proposals":[]}').otherwise('{"proposals":[{"suggestion_text":""}]}')
    return rows.select("trace_id", F.concat(L("r"), "trace_id").alias("report_id"), F.when(C("k") == 0, C("last")).when(C("k") == 4, "gone").alias("root_event_id"), F.when(C("k") == 1, 0).when(C("k") > 2, 99999).alias("root_step_index"), F.parse_json(recovery).alias("recovery"), F.when(C("k") == 1, F.array(L("try again"))).otherwise(F.array().cast("array<string>")).alias("suggestions"))


def _found(runs: DataFrame) -> DataFrame:
    lost = runs.groupBy("trace_id").agg(F.lit(-1).alias("ordinal"), F.lit("elsewhere").alias("event_id"), F.lit("").alias("suggestion"))
    return lost.unionByName(runs.where("error is not null").select("trace_id", C("pos").alias("ordinal"), "event_id", F.concat(L("mind "), "error").alias("suggestion")))


def _requests(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    runs = event_runs(table(spark, sf_dir, "events")).withColumn("step_index", F.floor(C("pos") / 2).cast("int"))
    chosen = runs.where("pos = 3").select("trace_id", "event_id") if how.pop("chosen", False) else None
    return rerun.requests(_reports(runs), runs, _found(runs), chosen=chosen, **how)


_REPORTS = f"""WITH {EVT_SQL}, f AS (SELECT trace_id, arg_min(event_id, pos) AS e, min(pos) AS p, arg_min(error, pos) AS x, count(*) + 1 AS n FROM evt WHERE error IS NOT NULL GROUP BY 1),
r AS (SELECT trace_id, cast(substr(trace_id, 2) AS bigint) % 5 AS k, arg_max(event_id, pos) AS last, max(pos) AS top, arg_min(event_id, pos) AS first, max(CASE WHEN pos = 3 THEN event_id END) AS third FROM evt GROUP BY 1),
q AS (SELECT r.*, f.n, CASE WHEN k = 0 THEN last WHEN k = 1 THEN first WHEN e IS NOT NULL THEN e WHEN k = 4 THEN 'gone' END AS event_id, CASE WHEN k = 0 THEN top // 2 WHEN k = 1 THEN 0 WHEN e IS NOT NULL THEN p // 2 WHEN k > 2 THEN 99999 END AS step_index, CASE WHEN k = 0 THEN 'use less' WHEN k = 1 THEN 'try again' WHEN x IS NOT NULL THEN concat('mind ', x) ELSE '{rerun.NO_DIRECTIVE}' END AS directive FROM r LEFT JOIN f USING (trace_id)) """
_REST = f"k > 0 AS needs_approval, coalesce(n, 1) AS n_findings, CASE WHEN k = 1 THEN 1 ELSE 0 END AS n_suggestions, {NULLS} AS error FROM q"
query("rerun_requests", _REPORTS + f"SELECT trace_id, concat('r', trace_id) AS report_id, event_id, cast(step_index AS int) AS step_index, 'from_root_cause' AS policy, directive, event_id AS target_event_id, {_REST}")(lambda s, d: _requests(s, d))
query("rerun_requests_from_start", _REPORTS + f"SELECT trace_id, concat('r', trace_id) AS report_id, {NULLS} AS event_id, NULL::INT AS step_index, 'from_start' AS policy, directive, CASE WHEN k = 0 THEN last WHEN k = 4 THEN 'gone' END AS target_event_id, {_REST}")(lambda s, d: _requests(s, d, from_start=True))
query("rerun_requests_chosen", _REPORTS + f"SELECT trace_id, concat('r', trace_id) AS report_id, coalesce(third, event_id) AS event_id, cast(CASE WHEN third IS NOT NULL THEN 1 ELSE step_index END AS int) AS step_index, 'from_root_cause' AS policy, directive, coalesce(third, event_id) AS target_event_id, {_REST}")(
    lambda s, d: _requests(s, d, chosen=True)
)

_META = """CASE turn % 4 WHEN 0 THEN '{"replay_bundle":{"environment_snapshot":"s","tool_manifest":[]}}' WHEN 1 THEN '{"replay_bundle":{"tool_manifest":{"a":1},"dependency_lock":1}}' WHEN 2 THEN '{}' END"""
query(
    "rerun_capability",
    """WITH c AS (SELECT conv_id, turn, turn % 4 AS k, conv_id % 3 AS m FROM conversations) SELECT conv_id, turn, CASE WHEN m = 0 THEN 'live_runner' WHEN m = 1 OR k > 1 THEN 'trajectory_only' ELSE 'replay_bundle' END AS level, m < 2 AS executable, CASE WHEN m = 0 THEN '' WHEN m = 1 OR k > 1 THEN 'framework_runner,tool_runtime,environment_state' WHEN k = 0 THEN 'framework_runner,tool_runtime' ELSE 'framework_runner,environment_state' END AS missing,
 concat_ws(',', 'diagnostic_report', CASE WHEN k < 3 THEN 'trajectory' END, CASE WHEN k < 2 THEN 'replay_bundle' END, CASE k WHEN 0 THEN 'environment_snapshot' WHEN 1 THEN 'tool_manifest,dependency_lock' END, CASE WHEN m = 0 THEN 'framework_runner,tool_runtime' END) AS available FROM c""",
)(
    lambda s, d: (
        table(s, d, "conversations").select("conv_id", "turn", rerun.capability(F.try_parse_json(F.expr(_META)), F.when(C("conv_id") % 3 == 0, "live_execution").when(C("conv_id") % 3 == 1, "simulated_rollout"), allow_simulated=True).alias("c"))
        .select("conv_id", "turn", "c.level", "c.executable", F.array_join("c.missing", ",").alias("missing"), F.array_join("c.available", ",").alias("available"))
    )
)
