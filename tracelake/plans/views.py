"""Queries of context views, quote checks and texts made from findings, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import advice, context, recover
from .events import FOUND, W, findings, rich
from .registry import query
from ..sources.fixtures import RICH_SQL

C, L = F.col, F.lit
WF = f"WITH {RICH_SQL}, {FOUND} "

query("view_history_tiers", W + "SELECT r.trace_id, f.focus, r.event_id, CASE WHEN event_type IN ('tool.result', 'observation', 'error', 'memory.read') THEN 'th3' WHEN focus - pos <= 2 THEN 'th1' WHEN focus - pos <= 5 THEN 'th2' ELSE 'th3' END AS tier FROM rich r JOIN (SELECT trace_id, pos AS focus FROM rich WHERE pos % 20 = 10) f ON f.trace_id = r.trace_id AND r.pos < f.focus")(
    lambda s, d: (lambda r: context.history_tiers(r, r.where("pos % 20 = 10").select("trace_id", C("pos").alias("focus"))))(rich(s, d))
)
query("view_prefix_pins", W + ", v AS (SELECT trace_id, event_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY trace_id) AS n FROM rich) WHERE pos < 3 OR pos >= n - 3 OR pos % 17 = 8) SELECT *, cast(pos - coalesce(lag(pos) OVER (PARTITION BY trace_id ORDER BY pos), -1) - 1 AS int) AS skipped FROM v")(lambda s, d: context.prefix_view(rich(s, d), 3, C("pos") % 17 == 8))
query("view_paired_steps", W + "SELECT trace_id, step_index, string_agg(concat(event_type, ': ', text), chr(10) ORDER BY event_type NOT IN ('tool.result', 'observation', 'error', 'memory.read'), pos) AS doc FROM rich WHERE step_index IS NOT NULL GROUP BY ALL")(lambda s, d: context.paired_steps(rich(s, d)))
query("view_step_history", W + "SELECT trace_id, event_id, least(pos, 5)::BIGINT AS n_before, CASE WHEN pos > 0 THEN cast(greatest(0, pos - 5) AS int) END AS from_pos FROM rich")(lambda s, d: context.step_history(rich(s, d), 5))
query("view_previous_step", W + "SELECT trace_id, step_index, lag(step_index) OVER (PARTITION BY trace_id ORDER BY step_index) AS previous FROM (SELECT DISTINCT trace_id, step_index FROM rich WHERE step_index IS NOT NULL AND pos % 7 > 2)")(lambda s, d: context.previous_step(rich(s, d).where("pos % 7 > 2")))
_MARKS = "m AS (SELECT DISTINCT trace_id, cast(pos * 3 AS int) AS t FROM rich WHERE pos % 9 = 4), st AS (SELECT DISTINCT trace_id, step_index AS x FROM rich WHERE step_index IS NOT NULL)"
query("view_error_context", W + f", {_MARKS}, h AS (SELECT m.trace_id, t, string_agg(x, ',' ORDER BY x) AS near FROM m LEFT JOIN st ON st.trace_id = m.trace_id AND abs(x - t) <= 1 GROUP BY ALL) SELECT h.trace_id, t, coalesce(near, (SELECT arg_min(x, struct_pack(d := abs(x - t), x := x)) FROM st WHERE st.trace_id = h.trace_id)::VARCHAR) AS steps FROM h")(
    lambda s, d: (lambda r: context.error_context(r, r.where("pos % 9 = 4").select("trace_id", (C("pos") * 3).cast("int").alias("t")).distinct()).select("trace_id", "t", F.array_join(C("steps").cast("array<string>"), ",").alias("steps")))(rich(s, d))
)
query("view_before_after", W + "SELECT trace_id, event_id, coalesce(CASE WHEN pos % 3 = 0 THEN concat('b', pos) END, lag(a) OVER (PARTITION BY trace_id ORDER BY pos)) AS before_image, a AS after_image FROM (SELECT *, CASE WHEN pos % 4 < 3 THEN concat('a', pos) END AS a FROM rich)")(
    lambda s, d: context.before_after(rich(s, d), F.when(C("pos") % 3 == 0, F.concat(L("b"), C("pos").cast("string"))), F.when(C("pos") % 4 < 3, F.concat(L("a"), C("pos").cast("string"))))
)
query("view_merged_summaries", W + "SELECT r.trace_id, r.step_index, r.event_id, m.s AS summary FROM rich r LEFT JOIN (SELECT trace_id, step_index, arg_max(concat(event_type, pos), pos) AS s FROM rich WHERE pos % 4 <> 1 AND step_index IS NOT NULL GROUP BY ALL) m ON m.trace_id = r.trace_id AND m.step_index = r.step_index")(
    lambda s, d: (lambda r: context.merged_summaries(r, r.where("pos % 4 <> 1").select("trace_id", "step_index", F.concat("event_type", C("pos").cast("string")).alias("summary"), C("pos").alias("ord"))))(rich(s, d))
)
query("view_nearest_kept_parent", W + ", p AS (SELECT trace_id, pos, event_id, event_type <> 'tool.call' AND pos % 5 <> 3 AS kept FROM rich) SELECT trace_id, event_id, max(CASE WHEN kept THEN pos END) OVER (PARTITION BY trace_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent_pos FROM p QUALIFY kept")(lambda s, d: _kept_parents(rich(s, d)))


def _kept_parents(runs: DataFrame) -> DataFrame:
    rows = runs.withColumn("parent_id", F.lag("event_id").over(context._run().orderBy("pos"))).select("trace_id", "event_id", "parent_id", ((C("event_type") != "tool.call") & (C("pos") % 5 != 3)).alias("kept"))
    at = runs.select("trace_id", C("event_id").alias("kept_parent"), C("pos").alias("parent_pos"))
    return context.nearest_kept(rows).join(at, ["trace_id", "kept_parent"], "left").select("trace_id", "event_id", "parent_pos")


query("view_bisection", W + "SELECT trace_id, cast(count(*) // 3 AS bigint) AS found FROM rich GROUP BY 1")(lambda s, d: (lambda r: context.bisect(r, r.groupBy("trace_id").agg(F.floor(F.count("*") / 3).alias("target"))).select("trace_id", "found"))(rich(s, d)))

# --- quotes

#: Which event types a conflict axis may quote as reference.
SCOPE = {
    "context": ("observation", "tool.result", "error", "llm.response", "memory.read"),
    "env": ("observation", "tool.result", "error"),
    "self": ("agent.step", "plan", "reflection", "llm.call"),
    "task": ("run.start", "human.feedback", "observation"),
}


def quoted(runs: DataFrame) -> DataFrame:
    """Findings with quotes: of their own event (with a truncation mark) or of none; a reference of any event, of the goal, or made up."""
    p = C("pos")
    wrong = F.when(p % 4 == 0, F.concat(F.substring("text", 1, 8), L(" ... [truncated]"))).when(p % 4 == 1, L("never said"))
    ref = F.when(p % 5 < 3, L("No results")).when(p % 5 == 3, L("solve it"))
    axis = F.element_at(F.array(L("context"), L("env"), L("self"), L("task"), L(None)), (p % 7 % 5 + 1).cast("int"))
    return runs.where("pos % 3 = 1").select("trace_id", F.concat(L("q"), "event_id").alias("finding_id"), "event_id", wrong.alias("wrong"), ref.alias("reference"), axis.alias("axis"))


_AXES = " OR ".join(f"(axis = '{a}' AND event_type IN ({', '.join(repr(k) for k in kinds)}))" for a, kinds in SCOPE.items() if a != "self")
QUOTES = f""", q AS (SELECT trace_id, concat('q', event_id) AS finding_id, event_id, pos, step_index AS cutoff, text AS source, CASE pos % 4 WHEN 0 THEN trim(left(text, 8)) WHEN 1 THEN 'never said' END AS wrong, CASE WHEN pos % 5 < 3 THEN 'No results' WHEN pos % 5 = 3 THEN 'solve it' END AS ref, ['context', 'env', 'self', 'task', NULL][pos % 7 % 5 + 1] AS axis FROM rich WHERE pos % 3 = 1),
c AS (SELECT finding_id, bool_or((axis IS NULL OR {_AXES} OR (axis = 'self' AND ((event_type IN ('agent.step', 'plan', 'reflection', 'llm.call') AND (cutoff IS NULL OR coalesce(step_index <= cutoff, false))) OR r.event_id = q.event_id))) AND contains(text, ref)) AS hit FROM q JOIN rich r USING (trace_id) WHERE ref IS NOT NULL GROUP BY 1),
v AS (SELECT q.trace_id, q.finding_id, CASE WHEN wrong IS NOT NULL OR ref IS NOT NULL THEN (wrong IS NULL OR contains(source, wrong)) AND (ref IS NULL OR coalesce(hit, false) OR ((axis IS NULL OR axis = 'task') AND contains('please solve it', ref))) END AS quote_verified FROM q LEFT JOIN c USING (finding_id)) """


def _verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = rich(spark, sf_dir)
    goals = runs.select("trace_id").distinct().withColumn("goal", L("please  solve it"))
    return context.verify_quotes(quoted(runs), runs, SCOPE, goals)


query("quotes_verified", W + QUOTES + "SELECT * FROM v")(_verified)
query("quotes_summary", W + QUOTES + "SELECT count(*) FILTER (quote_verified) AS verified, count(*) FILTER (NOT quote_verified) AS unsupported, count(*) FILTER (quote_verified IS NULL) AS unchecked FROM v")(lambda s, d: context.verification_summary(_verified(s, d)))

# --- texts


def advised(runs: DataFrame) -> DataFrame:
    """Findings with what advice needs: evidence, some suggestions, some templates."""
    o = C("ordinal")
    return findings(runs).withColumns({"suggestion": F.when(o % 3 == 0, F.concat(L("Check "), "mode_id")), "templates": F.when(o % 3 == 1, F.array(L("Slow down"))).otherwise(F.array().cast("array<string>")), "evidence": F.when(o % 2 == 0, F.array(L("e1"), "event_id")).otherwise(F.array().cast("array<string>")), "goal": F.when(o % 4 > 0, F.concat(L("solve "), "trace_id")), "framework": L("f"), "mode_name": F.upper("mode_id"), "root_step": L(7)})


ADV = WF + ", a AS (SELECT *, CASE WHEN ordinal % 3 = 0 THEN concat('Check ', mode_id) END AS suggestion, CASE WHEN ordinal % 3 = 1 THEN 'Slow down' END AS template, CASE WHEN ordinal % 2 = 0 THEN concat('  - e1', chr(10), '  - ', event_id) ELSE '  (none)' END AS ev, CASE WHEN ordinal % 4 > 0 THEN concat('solve ', trace_id) ELSE '(no goal recorded)' END AS goal FROM fnd) "
_N = "coalesce(step_index::VARCHAR, 'None')"
query("advice_retry_hints", ADV + f"SELECT finding_id, concat('Task: ', goal, chr(10), 'Framework: f', chr(10), 'Observed failure mode: ', mode_id, ' (', upper(mode_id), ')', chr(10), 'Located at agent=', agent_name, ', step=', {_N}, ', event_id=', event_id, chr(10), 'Evidence:', chr(10), ev, chr(10), 'Next time, do the following:', chr(10), '  ', coalesce(suggestion, template, 'Inspect the offending step and constrain the agent at that point.'), chr(10)) AS text, least(0.9, greatest(0.1, coalesce(confidence, 0)))::DOUBLE AS confidence FROM a")(lambda s, d: advice.retry_hints(advised(rich(s, d))))
query("advice_root_directive", ADV + f"SELECT trace_id, finding_id, concat('Task: ', goal, chr(10), 'Root cause: step ', {_N}, ', agent ', agent_name, chr(10), 'Evidence:', chr(10), ev, chr(10), 'Fix for the retry:', chr(10), '  ', coalesce(suggestion, 'Re-attempt the step with the diagnosed mistake corrected.'), chr(10)) AS text, least(0.95, greatest(0.2, coalesce(confidence, 0)))::DOUBLE AS confidence FROM a QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY coalesce(step_index = 7, false) DESC, ordinal) = 1")(lambda s, d: advice.root_directive(advised(rich(s, d))))
query("advice_manual_rules", ADV + "SELECT finding_id, coalesce(suggestion, template) AS rule, least(0.9, greatest(0.4, coalesce(confidence, 0)))::DOUBLE AS confidence FROM a WHERE suggestion IS NOT NULL OR (template IS NOT NULL AND NOT contains('be quick, slow down.', lower(template)))")(lambda s, d: advice.manual_rules(advised(rich(s, d)), "Be quick, SLOW down."))
query("advice_suggestions", ADV + "SELECT trace_id, string_agg(suggestion, ' | ' ORDER BY first) AS suggestions FROM (SELECT trace_id, suggestion, min(ordinal) AS first FROM a WHERE suggestion IS NOT NULL GROUP BY ALL) GROUP BY 1")(lambda s, d: advice.distinct_suggestions(advised(rich(s, d))).select("trace_id", F.array_join("suggestions", " | ").alias("suggestions")))
query("advice_report_modes", ADV + "SELECT trace_id, m.modes AS modes, f.families AS families FROM (SELECT trace_id, string_agg(mode_id, ',' ORDER BY first) AS modes FROM (SELECT trace_id, mode_id, min(ordinal) AS first FROM a GROUP BY ALL) GROUP BY 1) m JOIN (SELECT trace_id, string_agg(family, ',' ORDER BY first) AS families FROM (SELECT trace_id, split_part(mode_id, '.', 1) AS family, min(ordinal) AS first FROM a GROUP BY ALL) GROUP BY 1) f USING (trace_id)")(lambda s, d: advice.report_modes(advised(rich(s, d))).select("trace_id", F.array_join("modes", ",").alias("modes"), F.array_join("families", ",").alias("families")))
query("advice_manifest", WF + "SELECT r.trace_id, any_value(framework) AS framework, concat('solve ', r.trace_id) AS goal, count(*) AS n_events, count(DISTINCT agent_name) AS n_agents, coalesce((SELECT count(*) FROM fnd WHERE fnd.trace_id = r.trace_id), 0) AS n_findings FROM rich r GROUP BY r.trace_id")(lambda s, d: (lambda r: advice.manifest(r, findings(r)))(rich(s, d)))
query("advice_otel_spans", W + "SELECT trace_id, event_id AS span_id, concat(trace_id, ':root') AS parent_id, event_type AS name, CASE WHEN coalesce(error, '') <> '' THEN 'ERROR' ELSE 'OK' END AS status, round(duration_ms, 6) AS duration_ms FROM rich UNION ALL SELECT trace_id, concat(trace_id, ':root'), NULL, 'agent.run', 'OK', round(sum(duration_ms), 6) FROM rich GROUP BY 1")(lambda s, d: advice.otel_spans(rich(s, d)))
query("advice_actor_tasks", ADV + """SELECT concat('task-', finding_id) AS task_id, trace_id, event_id, concat('{', CASE WHEN step_index IS NOT NULL THEN concat('"step_index":', step_index, ',') ELSE '' END, '"agent_name":"', agent_name, '"}') AS target, concat('{"mode_id":"', mode_id, '","fix":"', coalesce(suggestion, 'Re-attempt the step with the diagnosed mistake corrected.'), '"}') AS directive FROM a""")(lambda s, d: advice.actor_tasks(advised(rich(s, d))))
query("advice_reference_block", W + "SELECT trace_id, string_agg(concat('[', pos, '] ', agent_name, ': ', left(text, 12)), chr(10) ORDER BY pos) AS block FROM rich GROUP BY 1")(lambda s, d: advice.reference_block(rich(s, d), 12))
query("advice_trajectory_text", W + f"SELECT trace_id, string_agg(concat('Step ', {_N}, ' - ', agent_name, ': output=', text, ' error=', coalesce(error, '')), chr(10) ORDER BY pos) AS text FROM rich WHERE pos < 20 GROUP BY 1")(lambda s, d: advice.trajectory_text(rich(s, d), 20))
query("advice_root_summary", W + "SELECT trace_id, arg_min(event_id, pos) AS event_id, cast(coalesce(nullif(min(step_index), 0), max(step_index)) AS int) AS step_index FROM rich GROUP BY 1")(
    lambda s, d: advice.root_summary(rich(s, d).groupBy("trace_id").agg(F.min_by("event_id", "pos").alias("root_event"), F.min("step_index").alias("root_step"), F.max("step_index").alias("first_step"), F.max("event_id").alias("first_event")))
)
query("advice_verifiers", WF + f"SELECT finding_id, v.n AS verifier, concat('Add ', v.n, ' before ', mode_id, ' (step ', {_N}, ', agent ', agent_name, ')') AS summary, least(0.85, greatest(0.3, coalesce(confidence, 0)))::DOUBLE AS confidence FROM fnd JOIN (VALUES ('json_schema_guard', 'action'), ('tool_retry_guard', 'system'), ('plan_progress_guard', 'planning')) v(n, f) ON split_part(mode_id, '.', 1) = f")(
    lambda s, d: advice.verifier_advice(recover.served(findings(rich(s, d))))
)
