"""Queries of event rules and of blame resolution, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blame, rules
from ..operators.detect import KEYWORD_RULES
from ..sources.fixtures import RICH_SQL, rich_runs, table
from .registry import query

W = f"WITH {RICH_SQL} "


def rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rich_runs(table(spark, sf_dir, "events"))


def _has(words) -> str:
    return "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"


CONSTRAINT = "CASE WHEN trim(coalesce(decision_error, '')) <> '' THEN trim(decision_error) WHEN coalesce(dropped_constraint, violated_constraint) IS NOT NULL THEN concat('constraint ''', coalesce(dropped_constraint, violated_constraint), ''' was not preserved') END"
META_JSON = """concat('{', array_to_string(list_filter([CASE WHEN capture_owned THEN '"capture_owned":true' END, CASE WHEN decision_error IS NOT NULL THEN concat('"decision_error":"', decision_error, '"') END, CASE WHEN dropped_constraint IS NOT NULL THEN concat('"dropped_constraint":"', dropped_constraint, '"') END, concat('"status":"', status, '"'), CASE WHEN success IS NOT NULL THEN '"success":false' END, CASE WHEN violated_constraint IS NOT NULL THEN concat('"violated_constraint":"', violated_constraint, '"') END], lambda x: x IS NOT NULL), ','), '}')"""
TEXT = f"array_to_string(list_filter([event_type, text, error, {META_JSON}], lambda x: x IS NOT NULL), chr(10))"

query("rules_prefix", W + "SELECT trace_id, event_id, pos FROM rich WHERE pos < 5")(lambda s, d: rules.prefix(rich(s, d), 5).select("trace_id", "event_id", "pos"))
query("rules_position_range", W + "SELECT trace_id, event_id, pos FROM rich WHERE pos BETWEEN 3 AND 9")(lambda s, d: rules.position_range(rich(s, d), 3, 9).select("trace_id", "event_id", "pos"))
query("rules_event_text", W + f"SELECT event_id, {TEXT} AS text FROM rich")(lambda s, d: rich(s, d).select("event_id", rules.event_text().alias("text")))
query("rules_structured_constraint", W + f"SELECT event_id, {CONSTRAINT} AS detail FROM rich WHERE {CONSTRAINT} IS NOT NULL")(lambda s, d: rich(s, d).select("event_id", rules.structured_constraint().alias("detail")).where("detail is not null"))
query("rules_metadata_status", W + "SELECT event_id FROM rich WHERE lower(status) IN ('failed', 'failure', 'error')")(lambda s, d: rich(s, d).where(rules.failed_status()).select("event_id"))
query("rules_pack_resolution", W + "SELECT DISTINCT trace_id, CASE WHEN lower(framework) LIKE '%alfworld%' OR lower(framework) LIKE '%webshop%' THEN 'core,benchmark' ELSE 'core' END AS packs FROM rich")(
    lambda s, d: rich(s, d).groupBy("trace_id").agg(F.first("framework").alias("framework")).select("trace_id", F.array_join(rules.packs_of("auto"), ",").alias("packs"))
)
_KEYWORDS = " ".join(f"WHEN {_has(n)} THEN struct_pack(r := '{r}', m := '{m}', p := {p})" for r, m, n, p in sorted(KEYWORD_RULES, key=lambda x: x[3]))
FIRST = f"""hits AS (SELECT trace_id, event_id, pos, step_index, agent_name, CASE
 WHEN {CONSTRAINT} IS NOT NULL THEN struct_pack(r := 'core.planning.constraint_ignorance.structured', m := 'planning.constraint_ignorance', p := 50)
 WHEN contains(low, 'nothing happens') AND framework = 'alfworld' THEN struct_pack(r := 'benchmark.alfworld.no_op', m := 'planning.inefficient_plan', p := 50)
 WHEN {_has(rules.NO_PROGRESS)} AND framework = 'WebShop env' THEN struct_pack(r := 'benchmark.webshop.no_progress', m := 'planning.inefficient_plan', p := 60)
 WHEN error <> '' THEN struct_pack(r := 'core.explicit_error', m := CASE WHEN event_type IN ('tool.call', 'tool.result') THEN 'system.tool_execution_error' ELSE 'system.environment_error' END, p := 100)
 {_KEYWORDS} WHEN lower(status) IN ('failed', 'failure', 'error') THEN struct_pack(r := 'core.system.environment_error.metadata_status', m := 'system.environment_error', p := 1000) END AS h
 FROM (SELECT *, lower({TEXT}) AS low FROM rich))"""
query("rules_first_match", f"WITH {RICH_SQL}, {FIRST} SELECT trace_id, event_id, pos, step_index, agent_name, h.r AS rule_id, h.m AS mode_id, cast(h.p AS int) AS priority, CASE WHEN h.p = 50 AND h.m = 'planning.constraint_ignorance' THEN 0.95::DOUBLE END AS confidence FROM hits WHERE h IS NOT NULL")(lambda s, d: rules.first_match(rich(s, d)))
query("rules_attributable", W + "SELECT trace_id, event_id FROM rich WHERE CASE WHEN framework = 'custom' THEN event_type IN ('llm.response', 'agent.step') ELSE event_type NOT IN ('run.start', 'run.end') END")(
    lambda s, d: rules.attributable(rich(s, d), F.when(F.col("framework") == "custom", "paired_turns").otherwise("all_events")).select("trace_id", "event_id")
)
query("rules_judgable", W + "SELECT event_type, count(*) AS n FROM rich WHERE event_type IN ('agent.step', 'plan', 'tool.call', 'reflection', 'llm.response') GROUP BY 1")(lambda s, d: rules.judgable(rich(s, d)).groupBy("event_type").agg(F.count("*").alias("n")))
query("rules_capture_excluded", W + ", r AS (SELECT *, CASE WHEN event_type = 'reflection' THEN 'private_reasoning' WHEN capture_owned THEN 'integration_owned' END AS reason FROM rich), l AS (SELECT *, lag(event_type) OVER w AS bt, lag(reason) OVER w AS br FROM r WINDOW w AS (PARTITION BY trace_id ORDER BY pos)) SELECT trace_id, event_id, pos, coalesce(reason, CASE WHEN event_type = 'tool.result' AND bt = 'tool.call' AND br IS NOT NULL THEN 'parent_excluded' END) AS reason FROM l WHERE reason IS NOT NULL OR (event_type = 'tool.result' AND bt = 'tool.call' AND br IS NOT NULL)")(lambda s, d: rules.capture_excluded(rich(s, d)))
query("rules_problem_events", W + "SELECT trace_id, event_id FROM rich WHERE coalesce(error, '') <> '' OR regexp_matches(lower(concat(event_type, ' ', text)), 'missing context|premature|loop|handoff|failure|error')")(lambda s, d: rich(s, d).where(rules.has_problem()).select("trace_id", "event_id"))
query("rules_run_failed", W + "SELECT trace_id, coalesce(bool_or(NOT success), false) AS failed FROM rich GROUP BY 1")(lambda s, d: rules.run_failed(rich(s, d)))

# --- blames

BLAMES = """blames AS (SELECT trace_id, concat('b', event_id) AS blame_id, CASE pos % 4 WHEN 0 THEN event_id WHEN 1 THEN 'nope' END AS span_id, CASE WHEN pos % 20 = 13 THEN step_index + 40 WHEN pos % 30 <> 23 THEN step_index END AS step, CASE pos % 3 WHEN 0 THEN concat(upper(agent_name), ' (planner)') WHEN 1 THEN agent_name END AS agent FROM rich WHERE pos % 5 = 3)"""
FIRSTS = """st AS (SELECT trace_id, step_index AS step, arg_min(struct_pack(e := event_id, s := step_index, a := agent_name), pos) AS f, count(*) AS n FROM rich WHERE step_index IS NOT NULL GROUP BY ALL),
ag AS (SELECT trace_id, step_index AS step, agent_name AS agent, arg_min(struct_pack(e := event_id, s := step_index, a := agent_name), pos) AS f, count(*) AS n FROM rich WHERE step_index IS NOT NULL GROUP BY ALL),
b AS (SELECT blames.*, CASE WHEN r.event_id IS NOT NULL THEN struct_pack(e := r.event_id, s := r.step_index, a := r.agent_name) END AS of_id, st.f AS of_step, st.n AS n_step, ag.f AS of_agent, ag.n AS n_agent, cn.f AS of_canon, cn.n AS n_canon, lower(trim(split_part(coalesce(blames.agent, ''), '(', 1))) AS canon FROM blames LEFT JOIN rich r ON r.trace_id = blames.trace_id AND r.event_id = span_id LEFT JOIN st ON st.trace_id = blames.trace_id AND st.step = blames.step
 LEFT JOIN ag ON ag.trace_id = blames.trace_id AND ag.step = blames.step AND ag.agent = blames.agent LEFT JOIN ag cn ON cn.trace_id = blames.trace_id AND cn.step = blames.step AND cn.agent = lower(trim(split_part(coalesce(blames.agent, ''), '(', 1))))"""
WB = f"WITH {RICH_SQL}, {BLAMES}, {FIRSTS} "
PICK = "SELECT trace_id, blame_id, ev.e AS event_id, ev.s AS step_index, ev.a AS agent_name FROM (SELECT *, {} AS ev FROM b)"


def blames(runs: DataFrame) -> DataFrame:
    """Made-up blames: right, wrong and missing spans, steps that are ordinals, agents in another spelling."""
    p = F.col("pos")
    span = F.when(p % 4 == 0, F.col("event_id")).when(p % 4 == 1, F.lit("nope"))
    step = F.when(p % 20 == 13, F.col("step_index") + 40).when(p % 30 != 23, F.col("step_index"))
    agent = F.when(p % 3 == 0, F.concat(F.upper("agent_name"), F.lit(" (planner)"))).when(p % 3 == 1, F.col("agent_name"))
    return runs.where("pos % 5 = 3").select("trace_id", F.concat(F.lit("b"), "event_id").alias("blame_id"), span.alias("span_id"), step.alias("step"), agent.alias("agent"))


def _blamed(f):
    return lambda s, d: (lambda r: f(blames(r), r))(rich(s, d))


query("blame_event", WB + PICK.format("coalesce(of_id, of_step)"))(_blamed(blame.blamed_event))
query("blame_resolve_candidate", WB + PICK.format("coalesce(CASE WHEN (step IS NULL OR of_id.s = step) AND (canon = '' OR lower(of_id.a) = canon) THEN of_id END, CASE WHEN canon <> '' AND n_canon = 1 THEN of_canon END, CASE WHEN n_step = 1 THEN of_step END)"))(_blamed(blame.resolve_candidate))
query("blame_attributed_event", WB + PICK.format("coalesce(of_id, CASE WHEN coalesce(agent, '') = '' AND n_step = 1 THEN of_step END, CASE WHEN n_agent = 1 THEN of_agent END)"))(_blamed(blame.attributed_event))
query("blame_normalize", WB + ", o AS (SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY pos) - 1 AS step, struct_pack(e := event_id, s := step_index, a := agent_name) AS f FROM rich WHERE event_type NOT IN ('run.start', 'run.end')) SELECT trace_id, blame_id, ev.e AS event_id, ev.s AS step_index, ev.a AS agent_name FROM (SELECT b.*, coalesce(of_id, of_agent, of_step, o.f) AS ev FROM b LEFT JOIN o ON o.trace_id = b.trace_id AND o.step = b.step)")(_blamed(blame.normalize))
query("blame_prefer_finding", f"WITH {RICH_SQL}, {BLAMES}, {FIRST}, fit AS (SELECT b.trace_id, b.blame_id, any_value(b.span_id) AS span_id, count(h.event_id) AS n, min(h.event_id) AS target FROM blames b LEFT JOIN (SELECT * FROM hits WHERE h IS NOT NULL) h ON h.trace_id = b.trace_id AND h.step_index = b.step AND (b.agent IS NULL OR h.agent_name = b.agent) GROUP BY ALL) SELECT trace_id, blame_id, CASE WHEN n = 1 THEN target ELSE span_id END AS span_id, n = 1 AND span_id IS DISTINCT FROM target AS anchored FROM fit")(
    lambda s, d: (lambda r: blame.prefer_finding(blames(r), rules.first_match(r)))(rich(s, d))
)


def findings(runs: DataFrame) -> DataFrame:
    """First matches with an id, an order in the run and a text that they contradict."""
    quote = F.when(F.col("pos") % 3 > 0, F.concat(F.lit(" Rule  "), F.upper("mode_id")))
    return rules.first_match(runs).select("trace_id", F.concat(F.lit("f"), "event_id").alias("finding_id"), "event_id", "step_index", "agent_name", "mode_id", "confidence", F.col("pos").alias("ordinal"), quote.alias("reference_quote"))


FOUND = f"{FIRST}, fnd AS (SELECT trace_id, concat('f', event_id) AS finding_id, event_id, step_index, agent_name, h.m AS mode_id, CASE WHEN h.p = 50 AND h.m = 'planning.constraint_ignorance' THEN 0.95::DOUBLE END AS confidence, pos AS ordinal, CASE WHEN pos % 3 > 0 THEN concat('rule ', lower(h.m)) END AS reference FROM hits WHERE h IS NOT NULL)"
query("blame_recovery_target", f"WITH {RICH_SQL}, {FOUND}, t AS (SELECT trace_id, event_id, step_index, agent_name FROM rich WHERE pos % 7 = 2) SELECT t.trace_id, t.event_id, coalesce((SELECT arg_min(finding_id, ordinal) FROM fnd WHERE fnd.trace_id = t.trace_id AND fnd.event_id = t.event_id), (SELECT arg_min(finding_id, ordinal) FROM fnd WHERE fnd.trace_id = t.trace_id AND fnd.step_index = t.step_index AND fnd.agent_name = t.agent_name), (SELECT arg_min(finding_id, ordinal) FROM fnd WHERE fnd.trace_id = t.trace_id)) AS finding_id FROM t")(
    lambda s, d: (lambda r: blame.recovery_target(r.where("pos % 7 = 2").select("trace_id", "event_id", "step_index", "agent_name"), findings(r)))(rich(s, d))
)
INSTANCES = f"WITH {RICH_SQL}, {FOUND}, ins AS (SELECT trace_id, coalesce(reference, concat('~', finding_id)) AS key, min(ordinal) AS seen, count(*) AS n, arg_min(finding_id, struct_pack(a := step_index IS NULL, b := step_index, c := -coalesce(confidence, 0), d := ordinal)) AS origin_id, min(step_index) AS first_step, max(step_index) AS last_step, max(coalesce(confidence, 0)) AS confidence FROM fnd GROUP BY ALL), num AS (SELECT trace_id, cast(row_number() OVER (PARTITION BY trace_id ORDER BY seen) - 1 AS int) AS instance, n, origin_id, first_step, last_step, confidence FROM ins) "
query("blame_instances", INSTANCES + "SELECT * FROM num")(lambda s, d: blame.cluster(findings(rich(s, d))))
for _policy, _order in (("earliest", "first_step IS NULL, first_step, confidence DESC"), ("confident", "confidence DESC, first_step IS NULL, first_step")):
    query(f"blame_rank_{_policy}", INSTANCES + f"SELECT *, cast(row_number() OVER (PARTITION BY trace_id ORDER BY n > 5, {_order}, instance) AS int) AS rank FROM num")(lambda s, d, p=_policy: blame.rank_instances(blame.cluster(findings(rich(s, d))), p, F.col("n") > 5))
_PROPOSE = "SELECT trace_id, concat('p', pos % 6) AS proposer, CASE WHEN pos % 6 < 5 THEN cast(pos % 3 AS int) END AS step, (pos % 4) / 4.0::DOUBLE AS confidence FROM rich WHERE pos < 6"
query("blame_proposal_order", W + f"SELECT trace_id, proposer, cast(row_number() OVER (PARTITION BY trace_id ORDER BY step IS NULL, step, -confidence, proposer) AS int) AS place FROM ({_PROPOSE})")(
    lambda s, d: _proposals(rich(s, d)).select("trace_id", "proposer", F.row_number().over(blame.Window.partitionBy("trace_id").orderBy(*blame.proposal_order())).alias("place"))
)
query("blame_promoted_proposal", W + f", p AS ({_PROPOSE}), v AS (SELECT *, CASE WHEN step IS NOT NULL THEN count(*) OVER (PARTITION BY trace_id, step) END AS votes FROM p) SELECT trace_id, proposer, step, coalesce(votes, 0) AS votes, u AS unanimous FROM (SELECT *, count(*) OVER w > 1 AND count(step) OVER w = count(*) OVER w AND min(step) OVER w = max(step) OVER w AS u FROM v WINDOW w AS (PARTITION BY trace_id)) QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY coalesce(votes, -1) DESC, step IS NULL, step, -confidence, proposer) = 1")(lambda s, d: blame.promote(_proposals(rich(s, d))))


def _proposals(runs: DataFrame) -> DataFrame:
    p = F.col("pos")
    return runs.where("pos < 6").select("trace_id", F.concat(F.lit("p"), (p % 6).cast("string")).alias("proposer"), F.when(p % 6 < 5, (p % 3).cast("int")).alias("step"), ((p % 4) / 4).alias("confidence"))


query("blame_gold_scores", W + ", g AS (SELECT event_id, CASE pos % 3 WHEN 0 THEN 'Agent_1 ' WHEN 1 THEN 'agent' END AS gold_agent, CASE WHEN pos % 4 > 0 THEN step_index + pos % 4 - 1 END AS gold_step, agent_name AS agent, step_index AS step FROM rich), m AS (SELECT event_id, (gold_agent IS NOT NULL OR gold_step IS NOT NULL) AS known, coalesce(contains(agent, lower(trim(gold_agent))) OR contains(lower(trim(gold_agent)), agent), false) AS a, coalesce(step = gold_step, false) AS x, coalesce(abs(step - gold_step) <= 1, false) AS nr FROM g) SELECT event_id, CASE WHEN known THEN a END AS agent_match, CASE WHEN known THEN x END AS exact_step, CASE WHEN known THEN nr END AS near_step, CASE WHEN known THEN a AND x END AS both_exact, CASE WHEN known THEN a AND nr END AS both_near FROM m")(
    lambda s, d: (lambda r, p: blame.score_gold(r.select("event_id", F.when(p % 3 == 0, F.lit("Agent_1 ")).when(p % 3 == 1, F.lit("agent")).alias("gold_agent"), F.when(p % 4 > 0, F.col("step_index") + p % 4 - 1).alias("gold_step"), F.col("agent_name").alias("agent"), F.col("step_index").alias("step"))).select("event_id", "agent_match", "exact_step", "near_step", "both_exact", "both_near"))(rich(s, d), F.col("pos"))
)
