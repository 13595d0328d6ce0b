"""Registered queries and their oracles: name -> (function, SQL or None)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import attribute, detect, evaluate, memory, overview, recover, rules, scrub, windows
from ..sources import exports, ingest
from ..sources.fixtures import EVT_SQL, conversation_runs, event_runs, table
from . import agent_logs, budgets, events, evidences, imports, labels, more, reruns, texts, views, wires  # noqa: F401
from .registry import ORACLES, QUERIES, query  # noqa: F401

BUDGET = 65

FAILED_SQL = "failed AS (SELECT trace_id, coalesce(bool_or(NOT success), false) AS failed, count(*) AS n_events FROM evt GROUP BY 1)"
FINDINGS_SQL = f"""calls AS (SELECT trace_id, agent_name, payload AS signature, count(*) AS n, max(struct_pack(pos := pos, event_id := event_id)) AS last, min(pos) AS first_pos
 FROM evt WHERE event_type='tool.call' GROUP BY ALL HAVING count(*) >= 3),
budget AS (SELECT trace_id, count(*) AS n, max(struct_pack(pos := pos, event_id := event_id)) AS last FROM evt GROUP BY 1 HAVING count(*) > {BUDGET}),
found AS (SELECT trace_id, event_id, pos, CASE WHEN event_type IN ('tool.call','tool.result') THEN 'system.tool_execution_error' ELSE 'system.environment_error' END AS mode_id, 0 AS phase, 0.5 + (pos % 10)/100.0::DOUBLE AS confidence FROM evt WHERE error <> ''
 UNION ALL SELECT trace_id, last.event_id, last.pos, 'planning.inefficient_plan', 1, 0.7::DOUBLE FROM calls
 UNION ALL SELECT trace_id, last.event_id, last.pos, 'planning.inefficient_plan', 2, 0.6::DOUBLE FROM budget)"""
SUMMARY_SQL = """summary AS (SELECT e.*, coalesce(f.n_findings, 0) AS n_findings, f.first_pos FROM
 (SELECT trace_id, count(*) AS n_events, count(error) AS n_errors, sum(cast(trunc(duration_ms) AS bigint)) AS total_ms FROM evt GROUP BY 1) e
 LEFT JOIN (SELECT trace_id, count(*) AS n_findings, min(pos) AS first_pos FROM found GROUP BY 1) f USING (trace_id))"""
W_RICH = events.W
W_EVT, W_FOUND = f"WITH {EVT_SQL} ", f"WITH {EVT_SQL}, {FINDINGS_SQL} "
W_SUM = f"WITH {EVT_SQL}, {FINDINGS_SQL}, {SUMMARY_SQL} "
#: Label pairs: quality against toxic, as tags; steps from the ids, so that every metric has work to do.
PAIRS_SQL = "pairs AS (SELECT doc_id, concat('T', quality) AS h_tag, concat('T', 1 - toxic) AS l_tag, doc_id % 7 AS h_step, (doc_id * 3) % 7 AS l_step, concat('a', doc_id % 3) AS annotator FROM labels)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_runs(table(spark, sf_dir, "events"))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.findings(_runs(spark, sf_dir), BUDGET)


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.run_summary(_runs(spark, sf_dir), _found(spark, sf_dir))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    tag = lambda c: F.concat(F.lit("T"), c.cast("string"))
    return table(spark, sf_dir, "labels").select("doc_id", tag(F.col("quality")).alias("h_tag"), tag(1 - F.col("toxic")).alias("l_tag"), (d % 7).alias("h_step"), (d * 3 % 7).alias("l_step"), F.concat(F.lit("a"), (d % 3).cast("string")).alias("annotator"))


# --- detection

query("detect_repeated_tool_call", W_FOUND + "SELECT trace_id, agent_name, signature, n, last.event_id AS event_id, last.pos AS pos, first_pos FROM calls")(lambda s, d: detect.repeated_tool_calls(_runs(s, d)))
query("detect_step_budget", W_FOUND + "SELECT trace_id, n, last.event_id AS event_id, last.pos AS pos FROM budget")(lambda s, d: detect.step_budget(_runs(s, d), BUDGET))
query("detect_explicit_errors", W_EVT + "SELECT trace_id, event_id, pos, agent_name, CASE WHEN event_type IN ('tool.call','tool.result') THEN 'system.tool_execution_error' ELSE 'system.environment_error' END AS mode_id FROM evt WHERE error <> ''")(lambda s, d: detect.explicit_errors(_runs(s, d)))
query("detect_failed_runs", f"WITH {EVT_SQL}, {FAILED_SQL} SELECT * FROM failed")(lambda s, d: detect.failed_runs(_runs(s, d)))
query(
    "detect_repeated_state",
    W_EVT
    + """, s AS (SELECT trace_id, event_id, pos, concat_ws('|', event_type, agent_name, payload, coalesce(error,'')) AS sig FROM evt WHERE event_type IN ('observation','agent.step','plan','tool.result')),
h AS (SELECT trace_id, event_id, pos, list(sig) OVER (PARTITION BY trace_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS held FROM s),
m AS (SELECT trace_id, event_id, pos, list_max(list_transform(held, lambda x: len(list_filter(held, lambda y: y = x)))) AS most FROM h WHERE len(held) = 4)
SELECT trace_id, event_id, pos, cast(most AS int) AS most FROM m WHERE most >= 3""",
)(lambda s, d: detect.repeated_states(_runs(s, d)))
_NEEDLES = (("fixture.license", "policy.license", ("license", "licensed under"), 100), ("fixture.article", "style.article", (" the ",), 300), *detect.KEYWORD_RULES)


def _keyword_sql(table_: str, key: str, rules) -> str:
    hit = lambda r: " OR ".join(f"contains(low, '{n}')" for n in r[2])
    order = sorted(rules, key=lambda r: r[3])
    case = lambda i, q: "CASE " + " ".join(f"WHEN {hit(r)} THEN {q}{r[i]}{q}" for r in order) + " END"
    return f"SELECT * FROM (SELECT {key}, {case(0, chr(39))} AS rule_id, {case(1, chr(39))} AS mode_id, cast({case(3, '')} AS int) AS priority FROM (SELECT {key}, lower(text) AS low FROM {table_})) WHERE rule_id IS NOT NULL"


query("detect_keyword_first_match", _keyword_sql("documents", "doc_id", _NEEDLES))(lambda s, d: detect.keyword_first_match(table(s, d, "documents"), "doc_id", "text", _NEEDLES))
query(
    "detect_premature_success",
    f"WITH {EVT_SQL}, {FAILED_SQL}, c AS (SELECT e.*, CASE WHEN contains(payload,'k=4') THEN 'k=4' WHEN contains(payload,'k=1') THEN 'k=1' END AS claim FROM evt e JOIN failed USING (trace_id) WHERE failed AND event_type IN ('reflection','observation','llm.response','agent.step','plan')) SELECT trace_id, arg_max(event_id,pos) AS event_id, max(pos) AS pos, arg_max(claim,pos) AS claim FROM c WHERE claim IS NOT NULL GROUP BY 1",
)(lambda s, d: detect.premature_success(_runs(s, d), ("k=4", "k=1")))
query("detect_premature_claims", W_RICH + ", f AS (SELECT trace_id, coalesce(bool_or(NOT success OR (event_type = 'error' AND agent_name = 'system')), false) AS failed FROM rich GROUP BY 1), c AS (SELECT trace_id, event_id, pos FROM rich JOIN f USING (trace_id) WHERE failed AND event_type IN ('reflection', 'observation', 'llm.response', 'agent.step', 'plan') AND text LIKE '%the task is complete%') SELECT trace_id, arg_max(event_id, pos) AS event_id, max(pos) AS pos, 'task is complete' AS claim FROM c GROUP BY 1")(
    lambda s, d: detect.premature_success(events.rich(s, d).withColumn("success", rules.field("success", "boolean")), text="text")
)
query("detect_findings", W_FOUND + "SELECT * FROM found")(_found)
for _policy, _order in (("earliest", "pos, confidence DESC"), ("confident", "confidence DESC, pos")):
    query(f"diagnose_root_{_policy}", W_FOUND + f"SELECT trace_id, event_id, pos, mode_id, phase, confidence FROM found QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY {_order}, phase, event_id, mode_id) = 1")(lambda s, d, p=_policy: detect.select_root(_found(s, d), p))

# --- attribution

SPECTRUM_SQL = f"""WITH {EVT_SQL}, {FAILED_SQL}, sg AS (SELECT *, concat_ws('|', event_type, agent_name, payload) AS signature FROM evt),
tot AS (SELECT count(*) FILTER (failed) AS nf, count(*) FILTER (NOT failed) AS np FROM failed),
cnt AS (SELECT signature, count(*) FILTER (failed) AS ef, count(*) FILTER (NOT failed) AS ep FROM (SELECT DISTINCT trace_id, signature FROM sg) JOIN failed USING (trace_id) GROUP BY 1),
sp AS (SELECT cnt.*, tot.* FROM cnt, tot)"""
_SCORES = {
    "ochiai": "coalesce(ef / nullif(sqrt((ef + ep)::DOUBLE * nf), 0), 0)",
    "tarantula": "coalesce((ef::DOUBLE/nullif(nf,0)) / nullif(coalesce(ef::DOUBLE/nullif(nf,0),0) + coalesce(ep::DOUBLE/nullif(np,0),0), 0), 0)",
    "dstar": "CASE WHEN ep + (nf - ef) = 0 AND ef > 0 THEN 'inf'::DOUBLE ELSE coalesce(pow(ef,2)::DOUBLE / nullif(ep + (nf - ef), 0), 0) END",
}
for _f, _sql in _SCORES.items():
    query(f"attribute_sbfl_{_f}", SPECTRUM_SQL + f" SELECT signature, ef, ep, nf, np, round({_sql}, 9) AS score FROM sp")(lambda s, d, f=_f: attribute.suspiciousness(attribute.spectrum(_runs(s, d)), f).withColumn("score", F.round("score", 9)))
query(
    "attribute_sbfl_top",
    SPECTRUM_SQL + f", sc AS (SELECT signature, {_SCORES['ochiai']} AS score FROM sp) SELECT trace_id, event_id, pos, round(score, 9) AS score, cast(r AS int) AS rank FROM (SELECT sg.*, score, row_number() OVER (PARTITION BY trace_id ORDER BY score DESC, coalesce(nullif(pos,0), 1000000000), pos) AS r FROM sg JOIN failed USING (trace_id) JOIN sc USING (signature) WHERE failed AND score > 0) WHERE r <= 5",
)(lambda s, d: attribute.spectrum_top(_runs(s, d)).withColumn("score", F.round("score", 9)))


def _hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two methods' rankings of all findings of a run, from 0, so that the first of n has n Borda points and the last 1."""
    found = _found(spark, sf_dir)
    out = []
    for method, weight, order in (("early", 1.0, [F.col("pos")]), ("sure", 0.5, [F.desc("confidence")])):
        w = Window.partitionBy("trace_id")
        ranked = found.withColumn("rank", F.row_number().over(w.orderBy(*order, "phase", "event_id", "mode_id")) - 1).withColumn("n", F.count("*").over(w))
        out.append(ranked.select("trace_id", "event_id", F.lit(method).alias("method"), "rank", "n", F.lit(weight).alias("weight"), "confidence"))
    return out[0].unionByName(out[1])


ALL_SQL = W_FOUND + ", early AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY pos, phase, event_id, mode_id) AS r, count(*) OVER (PARTITION BY trace_id) AS n FROM found), sure AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY confidence DESC, phase, event_id, mode_id) AS r, count(*) OVER (PARTITION BY trace_id) AS n FROM found), hyp AS (SELECT trace_id, event_id, n - r + 1 AS place, 1.0::DOUBLE AS weight, confidence FROM early UNION ALL SELECT trace_id, event_id, n - r + 1, 0.5::DOUBLE, confidence FROM sure)"
query("attribute_borda", ALL_SQL + " SELECT trace_id, event_id, round(sum(place*weight),6) AS points, round(least(1, sum(weight*confidence)/sum(weight)),6) AS confidence FROM hyp GROUP BY ALL")(
    lambda s, d: attribute.borda(_hypotheses(s, d)).select("trace_id", "event_id", F.round("points", 6).alias("points"), F.round("confidence", 6).alias("confidence"))
)
query("attribute_noisy_or", ALL_SQL + " SELECT trace_id, event_id, round(1 - product(1 - least(1, greatest(0, weight*confidence))), 6) AS confidence FROM hyp GROUP BY ALL")(lambda s, d: attribute.noisy_or(_hypotheses(s, d)).withColumn("confidence", F.round("confidence", 6)))
query("attribute_ensemble", ALL_SQL + ", b AS (SELECT trace_id, event_id, sum(place*weight) AS points, sum(weight*confidence) AS mass FROM hyp GROUP BY ALL) SELECT trace_id, event_id, 'ensemble' AS method FROM b QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY points DESC, mass DESC, event_id) = 1 UNION ALL SELECT trace_id, NULL, 'no_hypotheses' FROM (SELECT DISTINCT trace_id FROM evt) WHERE trace_id NOT IN (SELECT trace_id FROM found)")(
    lambda s, d: attribute.ensemble(_hypotheses(s, d), _runs(s, d))
)
query("attribute_heuristic", W_FOUND + "SELECT trace_id, f.event_id, CASE WHEN f.event_id IS NULL THEN 'no_findings' ELSE 'earliest' END AS method FROM (SELECT DISTINCT trace_id FROM evt) LEFT JOIN (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY pos, confidence DESC, phase, event_id, mode_id) = 1) f USING (trace_id)")(
    lambda s, d: attribute.heuristic(_found(s, d), _runs(s, d))
)
query("attribute_counterfactual_rank", W_FOUND + ", r AS (SELECT trace_id, event_id, max(confidence) AS confidence, cast(substr(event_id, -1) AS int) % 3 / 2.0::DOUBLE AS rescue FROM found GROUP BY ALL) SELECT trace_id, event_id, cast(row_number() OVER (PARTITION BY trace_id ORDER BY rescue DESC, confidence DESC, event_id) AS int) AS rank FROM r")(
    lambda s, d: attribute.rescue_rank(_found(s, d).groupBy("trace_id", "event_id").agg(F.max("confidence").alias("confidence")).withColumn("rescue", F.right("event_id", F.lit(1)).cast("int") % 3 / 2.0)).select("trace_id", "event_id", "rank")
)


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    return attribute.longest_prefix_references(runs, detect.failed_runs(runs).select("trace_id", "failed"))


DIFF_SQL = f"""WITH {EVT_SQL}, {FAILED_SQL}, act AS (SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY pos) - 1 AS ord, pos, concat_ws(':', agent_name, payload) AS action FROM evt WHERE event_type='tool.call'),
prs AS (SELECT f.trace_id AS failed, r.trace_id AS reference FROM failed f, failed r WHERE f.failed AND NOT r.failed),
b AS (SELECT p.failed, p.reference, l.ord, l.pos, l.ord IS NOT NULL AND (r.action IS NULL OR r.action <> l.action) AS apart FROM prs p LEFT JOIN act l ON l.trace_id = p.failed LEFT JOIN act r ON r.trace_id = p.reference AND r.ord = l.ord),
diffs AS (SELECT failed, reference, cast(coalesce(min(ord) FILTER (apart), count(ord)) AS int) AS aligned, min(pos) FILTER (apart) AS divergence_step FROM b GROUP BY failed, reference),
best AS (SELECT * FROM diffs QUALIFY row_number() OVER (PARTITION BY failed ORDER BY aligned DESC, reference) = 1)"""
# every passing run is a candidate, and a failed run without tool calls has a row too
query("attribute_best_reference", DIFF_SQL + " SELECT * FROM best")(_references)
query("attribute_prefix_divergence", DIFF_SQL + " SELECT failed, reference, aligned, divergence_step, CASE WHEN divergence_step IS NULL THEN '' ELSE array_to_string(list_filter([divergence_step - 1, divergence_step, divergence_step + 1], lambda x: x >= 0 AND x < n), ',') END AS candidates FROM best JOIN (SELECT trace_id, count(*) AS n FROM evt GROUP BY 1) z ON z.trace_id = failed")(lambda s, d: attribute.divergence_candidates(_references(s, d), _runs(s, d)))
query(
    "attribute_counterfactual_candidates",
    W_FOUND + ", c AS (SELECT trace_id, event_id, min(struct_pack(tier := tier, place := place)) AS o FROM (SELECT trace_id, event_id, 0 AS tier, pos AS place FROM found UNION ALL SELECT trace_id, event_id, 1, pos FROM evt WHERE error <> '' UNION ALL SELECT trace_id, event_id, 2, -pos FROM evt) GROUP BY ALL) SELECT trace_id, event_id, o.tier AS tier, cast(row_number() OVER (PARTITION BY trace_id ORDER BY o, event_id) AS int) AS rank FROM c QUALIFY rank <= 5",
)(lambda s, d: attribute.counterfactual_candidates(_runs(s, d), _found(s, d)))
query("attribute_decision_events", W_EVT + "SELECT trace_id, event_id, pos FROM (SELECT *, bool_or(dec) OVER (PARTITION BY trace_id) AS anyd FROM (SELECT *, event_type NOT IN ('environment','observation','run.start','run.end','tool.call','tool.result') AS dec FROM evt)) WHERE dec OR NOT anyd")(lambda s, d: attribute.decision_events(_runs(s, d)).select("trace_id", "event_id", "pos"))
query("attribute_multi_agent", W_EVT + "SELECT trace_id, count(DISTINCT agent_name) FILTER (agent_name NOT IN ('environment','agent','')) >= 2 AS multi_agent FROM evt GROUP BY 1")(lambda s, d: attribute.multi_agent(_runs(s, d)))

# --- overview

query("overview_kpis", W_SUM + "SELECT count(*) AS runs, count(*) FILTER (n_findings > 0) AS runs_with_findings, round(100.0 * count(*) FILTER (n_findings > 0) / count(*), 1)::DOUBLE AS error_rate, min(n_events) AS min_events, max(n_events) AS max_events, round(avg(n_events), 1) AS avg_events, round(avg(n_findings), 1) AS avg_findings, round(avg(first_pos), 1) AS avg_first_pos FROM summary")(lambda s, d: overview.kpis(_summary(s, d)))
query("overview_run_summary", W_SUM + "SELECT * FROM summary")(_summary)
query("overview_modes", W_FOUND + "SELECT mode_id, count(*) AS n, split_part(mode_id, '.', 1) AS family FROM found GROUP BY 1 ORDER BY n DESC, mode_id LIMIT 5")(lambda s, d: overview.mode_counts(_found(s, d)))
query("overview_failure_stage", W_SUM + "SELECT CASE WHEN first_pos IS NULL THEN 'none' WHEN first_pos::DOUBLE / greatest(1, n_events) <= 0.33 THEN 'early' WHEN first_pos::DOUBLE / greatest(1, n_events) <= 0.66 THEN 'middle' ELSE 'late' END AS stage, count(*) AS n FROM summary GROUP BY 1")(lambda s, d: overview.failure_stages(_summary(s, d)))
query("overview_step_histogram", W_SUM + "SELECT CASE WHEN first_pos <= 5 THEN '1-5' WHEN first_pos <= 15 THEN '6-15' WHEN first_pos <= 30 THEN '16-30' ELSE '31+' END AS bucket, count(*) AS n FROM summary WHERE first_pos IS NOT NULL GROUP BY 1")(lambda s, d: overview.step_histogram(_summary(s, d)))
query("overview_step_distribution", W_SUM + ", b AS (SELECT first_pos AS step, count(*) AS n FROM summary WHERE first_pos >= 1 GROUP BY 1) SELECT cast(s.step AS int) AS step, coalesce(b.n, 0) AS n FROM (SELECT unnest(range(1, (SELECT max(step) FROM b) + 1)) AS step) s LEFT JOIN b USING (step)")(lambda s, d: overview.step_distribution(_summary(s, d)))
query("overview_priorities", W_SUM + "SELECT trace_id, n_findings * 10 + greatest(0, 20 - coalesce(nullif(first_pos, 0), n_events)) + 5 AS score FROM summary WHERE n_findings > 0")(lambda s, d: overview.priorities(_summary(s, d)))
query("overview_timeline_roots", W_FOUND + ", root AS (SELECT trace_id, event_id AS root_id FROM found QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY pos, confidence DESC, phase, event_id, mode_id) = 1) SELECT trace_id, event_id, pos, CASE WHEN event_id = root_id THEN 'root' WHEN error IS NOT NULL THEN 'error' ELSE 'ok' END AS state FROM (SELECT *, count(*) OVER (PARTITION BY trace_id) AS n FROM evt) LEFT JOIN root USING (trace_id) WHERE pos % greatest(1, n // 48) = 0 OR pos = n - 1")(lambda s, d: overview.timeline(_runs(s, d), roots=detect.select_root(_found(s, d))))
query("overview_timeline", W_EVT + "SELECT trace_id, event_id, pos, CASE WHEN error IS NOT NULL THEN 'error' ELSE 'ok' END AS state FROM (SELECT *, count(*) OVER (PARTITION BY trace_id) AS n FROM evt) WHERE pos % greatest(1, n // 48) = 0 OR pos = n - 1")(lambda s, d: overview.timeline(_runs(s, d)))

# --- evaluation

W_PAIRS = f"WITH {PAIRS_SQL} "
JOINT_SQL = W_PAIRS + ", j AS (SELECT h_tag, l_tag, n, sum(n) OVER (PARTITION BY h_tag) AS h, sum(n) OVER (PARTITION BY l_tag) AS l, sum(n) OVER () AS total FROM (SELECT h_tag, l_tag, count(*)::DOUBLE AS n FROM pairs WHERE h_tag IS NOT NULL AND l_tag IS NOT NULL GROUP BY ALL))"
query("eval_headline", W_PAIRS + "SELECT count(*) AS n, round(avg((h_tag=l_tag)::int),4) AS tag_exact, round(avg((h_step=l_step)::int),4) AS step_exact, round(avg((abs(h_step-l_step)<=1)::int),4) AS step_within_1, round(avg((abs(h_step-l_step)<=2)::int),4) AS step_within_2, round(avg((abs(h_step-l_step)<=3)::int),4) AS step_within_3, round(avg((h_tag=l_tag AND h_step=l_step)::int),4) AS \"both\" FROM pairs")(lambda s, d: evaluate.headline(_pairs(s, d)))
query("eval_confusion", W_PAIRS + ", t AS (SELECT h_tag AS t FROM pairs UNION SELECT l_tag FROM pairs) SELECT a.t AS h_tag, b.t AS l_tag, count(p.doc_id) AS n FROM t a CROSS JOIN t b LEFT JOIN pairs p ON p.h_tag = a.t AND p.l_tag = b.t WHERE a.t IS NOT NULL AND b.t IS NOT NULL GROUP BY ALL")(lambda s, d: evaluate.confusion(_pairs(s, d)))
query("eval_precision_recall", W_PAIRS + ", r AS (SELECT h_tag AS tag, 1 AS h, 0 AS l, (h_tag=l_tag)::int AS ok FROM pairs UNION ALL SELECT l_tag, 0, 1, 0 FROM pairs), g AS (SELECT tag, sum(h)::BIGINT AS support, sum(l)::BIGINT AS predicted, sum(ok)::BIGINT AS correct FROM r GROUP BY 1), q AS (SELECT *, coalesce(correct::DOUBLE/nullif(predicted,0),0) AS p, coalesce(correct::DOUBLE/nullif(support,0),0) AS rc FROM g) SELECT tag, support, round(p,4) AS precision, round(rc,4) AS recall, round(coalesce(2*p*rc/nullif(p+rc,0),0),4) AS f1 FROM q")(lambda s, d: evaluate.precision_recall(_pairs(s, d)))
query("eval_step_errors", W_PAIRS + "SELECT round(avg(abs(l_step-h_step)),4) AS mae, round(avg(l_step-h_step),4) AS mean_error, count(*) FILTER (l_step<h_step) AS early, count(*) FILTER (l_step=h_step) AS exact, count(*) FILTER (l_step>h_step) AS late FROM pairs")(lambda s, d: evaluate.step_errors(_pairs(s, d)))
query("eval_per_annotator", W_PAIRS + "SELECT annotator, count(*) AS n, round(avg((h_tag=l_tag)::int),4) AS tag_exact FROM pairs GROUP BY 1")(lambda s, d: evaluate.per_annotator(_pairs(s, d), "annotator"))
query("eval_kappa", JOINT_SQL + ", o AS (SELECT sum(CASE WHEN h_tag=l_tag THEN n/total ELSE 0 END) AS po FROM j), c AS (SELECT coalesce(sum(ph*pl),0) AS pe FROM (SELECT DISTINCT h_tag AS t, h/total AS ph FROM j) JOIN (SELECT DISTINCT l_tag AS t, l/total AS pl FROM j) USING (t)) SELECT round(CASE WHEN pe < 1 THEN (po-pe)/(1-pe) END, 6) AS kappa FROM o, c")(lambda s, d: evaluate.kappa(_pairs(s, d)))
query("eval_nmi", JOINT_SQL + ", m AS (SELECT sum(n/total*ln((n/total)/((h/total)*(l/total)))) AS mi FROM j), a AS (SELECT -sum(q*ln(q)) AS e FROM (SELECT DISTINCT h_tag, h/total AS q FROM j)), b AS (SELECT -sum(q*ln(q)) AS e FROM (SELECT DISTINCT l_tag, l/total AS q FROM j)) SELECT round(coalesce(mi/nullif(sqrt(a.e*b.e),0),0),6) AS nmi FROM m, a, b")(lambda s, d: evaluate.nmi(_pairs(s, d)))

# --- recovery and reruns

TOOL_PAIRS_SQL = W_EVT + """, tp AS (SELECT trace_id, agent_name, call_id, call_pos, call, event_id AS result_id, pos AS result_pos FROM (SELECT *, lag(event_type) OVER w AS b, lag(event_id) OVER w AS call_id, lag(pos) OVER w AS call_pos, lag(payload) OVER w AS call
 FROM evt WHERE event_type IN ('tool.call','tool.result') WINDOW w AS (PARTITION BY trace_id, agent_name ORDER BY pos)) WHERE event_type='tool.result' AND b='tool.call')"""
query("recover_tool_pairs", TOOL_PAIRS_SQL + " SELECT * FROM tp")(lambda s, d: recover.tool_pairs(_runs(s, d)).drop("error"))
query("recover_saga_order", TOOL_PAIRS_SQL + " SELECT trace_id, call_id, call, cast(row_number() OVER (PARTITION BY trace_id ORDER BY result_pos DESC) AS int) AS undo FROM tp WHERE agent_name IN ('agent_0', 'agent_2') AND result_pos % 3 > 0")(
    lambda s, d: recover.saga_order(recover.tool_pairs(_runs(s, d).withColumn("error", F.when((F.col("event_type") == "tool.result") & (F.col("pos") % 3 == 0), "late").otherwise(F.col("error")))), ("agent_0", "agent_2"))
)
query("recover_verifiers", W_FOUND + "SELECT DISTINCT trace_id, event_id, CASE WHEN mode_id LIKE 'planning.%' THEN 'plan_progress_guard' ELSE 'tool_retry_guard' END AS verifier FROM found")(lambda s, d: recover.verifiers(_found(s, d)))
query("rerun_compare_branches", W_EVT + "SELECT trace_id, errors_before, errors_after, CASE WHEN errors_after < errors_before THEN 'improved' WHEN errors_after > errors_before THEN 'worse' ELSE 'unchanged' END AS verdict FROM (SELECT trace_id, count(*) FILTER (coalesce(error,'')<>'' AND pos%2=0) AS errors_before, count(*) FILTER (coalesce(error,'')<>'' AND pos%2=1) AS errors_after FROM evt GROUP BY 1 HAVING count(*) FILTER (pos%2=1) > 0)")(
    lambda s, d: recover.compare_branches(_runs(s, d).where("pos % 2 = 0"), _runs(s, d).where("pos % 2 = 1"))
)
query("rerun_evaluate_suffix", W_EVT + ", c AS (SELECT trace_id, count(*) FILTER (coalesce(error,'')<>'') AS original, count(*) FILTER (coalesce(error,'')<>'' AND event_type='error' AND pos%3=0) AS rerun FROM evt WHERE pos >= 20 GROUP BY 1) SELECT *, CASE WHEN original > 0 AND rerun = 0 THEN 'resolved' WHEN rerun < original THEN 'improved' WHEN rerun > original THEN 'worse' ELSE 'unchanged' END AS result FROM c")(
    lambda s, d: recover.evaluate_suffix(_runs(s, d), _runs(s, d).where("pos % 3 = 0"), 20)
)

# --- windows

query("window_chunks", W_EVT + "SELECT trace_id, pos // 16 AS chunk, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM evt GROUP BY ALL")(lambda s, d: windows.chunks(_runs(s, d), 16))
query("window_segments", W_EVT + "SELECT trace_id, segment, count(*) AS n FROM (SELECT *, bool_or(error = 'code 3') OVER (PARTITION BY trace_id, segment) AS bad FROM (SELECT *, cast(sum((event_type='observation')::int) OVER (PARTITION BY trace_id ORDER BY pos) AS int) AS segment FROM evt)) WHERE NOT coalesce(bad, false) GROUP BY ALL")(
    lambda s, d: windows.segments(_runs(s, d), "event_type = 'observation'", "coalesce(error = 'code 3', false)")
)
query("window_size_budget", W_EVT + "SELECT trace_id, event_id, running, cast(row_number() OVER (PARTITION BY trace_id ORDER BY pos) - 1 AS int) AS step_index FROM (SELECT *, cast(sum(length(event_type) + length(payload)) OVER (PARTITION BY trace_id ORDER BY pos) AS bigint) AS running FROM evt) WHERE running <= 600")(
    lambda s, d: windows.size_budget(_runs(s, d), "length(event_type) + length(payload)", 600)
)
query("window_head_tail", W_EVT + "SELECT trace_id, event_id, pos, n FROM (SELECT *, count(*) OVER (PARTITION BY trace_id) AS n FROM evt) WHERE n <= 14 OR pos < 7 OR pos >= n - 7")(lambda s, d: windows.head_tail(_runs(s, d)))
query("window_occurrences", W_EVT + "SELECT trace_id, event_id, cast(row_number() OVER (PARTITION BY trace_id, event_type, payload ORDER BY pos) - 1 AS int) AS nth FROM evt")(lambda s, d: windows.occurrences(_runs(s, d)))
query("window_last_emitted", W_EVT + "SELECT trace_id, event_id, last_value(CASE WHEN event_type='tool.call' THEN event_id END IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent_id FROM evt")(lambda s, d: windows.last_emitted(_runs(s, d)))
query("window_around_errors", W_EVT + "SELECT e.trace_id, e.event_id, count(*) AS near FROM evt e JOIN evt m ON m.trace_id = e.trace_id AND m.success = false AND m.pos BETWEEN e.pos - 2 AND e.pos + 2 GROUP BY ALL")(lambda s, d: windows.around(_runs(s, d), _runs(s, d).where("success = false"), 2))
query("window_round_robin", "SELECT source, cast((row_number() OVER (ORDER BY source) - 1) % 3 AS int) AS annotator FROM (SELECT DISTINCT source FROM documents)")(lambda s, d: windows.round_robin(table(s, d, "documents"), "source", 3))

# --- text, memory, ingest, stores



def _scrubbed() -> str:
    """The rules one after the other. Where a pattern looks around, its borders are captured, and a second pass takes what shares one."""
    ctes, counts = ["r0 AS (SELECT doc_id, text FROM documents)"], []
    for i, (name, pattern, put) in enumerate(scrub.REDACTIONS, 1):
        bare = re.sub(r"^\(\?<!\[(.*?)\]\)(.*)\(\?!\[.*\]\)$", r"(^|[^\1])(\2)($|[^\1])", pattern)
        if bare != pattern:
            once = lambda t, bare=bare, put=put: f"regexp_replace({t}, '{bare}', '\\1{put}\\3', 'g')"
            new = once(once("text"))
            ctes.append(f"r{i} AS (SELECT * EXCLUDE (text, before), text, ((length(text) - length(replace(text, '{put}', ''))) - (length(before) - length(replace(before, '{put}', '')))) // {len(put)} AS {name} FROM (SELECT * EXCLUDE (text), text AS before, {new} AS text FROM r{i - 1}))")
        elif r"\d" in pattern:
            # letters beyond ASCII are words' characters too: marks that are stand for them at the borders of digits
            text = r"regexp_replace(text, '([\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2C1}\x{370}-\x{1FFF}\x{2C00}-\x{D7FF}])', 'QzQ\1QzQ', 'g')"
            ctes.append(f"r{i} AS (SELECT * EXCLUDE (text, marked), len(regexp_extract_all(marked, '{pattern}')) AS {name}, replace(regexp_replace(marked, '{pattern}', '{put}', 'g'), 'QzQ', '') AS text FROM (SELECT *, {text} AS marked FROM r{i - 1}))")
        else:
            ctes.append(f"r{i} AS (SELECT * EXCLUDE (text), len(regexp_extract_all(text, '{pattern}')) AS {name}, regexp_replace(text, '{pattern}', '{put.replace('$1', chr(92) + '1')}', 'g') AS text FROM r{i - 1})")
        counts.append(f"cast({name} AS int) AS {name}")
    return f"WITH {', '.join(ctes)} SELECT doc_id, text, {', '.join(counts)} FROM r{len(scrub.REDACTIONS)}"


query("ingest_host_redacted", f"SELECT d.doc_id, CASE WHEN d.doc_id % 2 = 0 THEN s.text ELSE d.text END AS output, CASE WHEN d.doc_id % 2 = 0 THEN 'mail <redacted:email>' ELSE 'mail a@b.org' END AS error FROM documents d JOIN ({_scrubbed()}) s ON s.doc_id = d.doc_id")(
    lambda s, d: scrub.redact_hosts(table(s, d, "documents").select("doc_id", F.col("text").alias("output"), F.lit("mail a@b.org").alias("error"), F.when(F.col("doc_id") % 2 == 1, "messages").when(F.col("doc_id") % 4 == 0, "rollout").otherwise("session_records").alias("format"))).drop("format")
)
query("text_scrub", _scrubbed())(lambda s, d: scrub.scrub(table(s, d, "documents"), "doc_id", "text"))
query("text_scrub_emails", r"SELECT doc_id, len(regexp_extract_all(text, '\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b')) AS email, regexp_replace(text, '\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b', '<redacted:email>', 'g') AS text FROM documents")(
    lambda s, d: scrub.scrub(table(s, d, "documents"), "doc_id", "text", tuple(r for r in scrub.REDACTIONS if r[0] == "email"))
)
query("text_clip_middle", "SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE concat(left(text, 117), chr(10) || '...' || chr(10), right(text, 78)) END AS clipped FROM documents")(lambda s, d: table(s, d, "documents").select("doc_id", T.clip_middle(F.col("text"), 200).alias("clipped")))
query("text_stable_ids", "SELECT conv_id, turn, sha256(concat(conv_id::varchar, chr(0), turn::varchar, chr(0), role)) AS id FROM conversations")(lambda s, d: table(s, d, "conversations").select("conv_id", "turn", T.stable_id(F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.col("role")).alias("id")))
query(
    "text_token_overlap",
    "WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM conversations), p AS (SELECT a.conv_id, a.turn, a.w AS x, b.w AS y FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1) SELECT conv_id, turn, round(coalesce(len(list_intersect(x,y))::DOUBLE / nullif(len(list_distinct(list_concat(x,y))),0),0),9) AS jaccard, cast(len(list_filter(x, lambda z: NOT list_contains(y, z))) AS int) AS gain FROM p",
)(
    lambda s, d: (
        lambda t: t.join(t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("y")), ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.jaccard(F.col("w"), F.col("y")), 9).alias("jaccard"), F.size(F.array_except("w", "y")).alias("gain"))
    )(table(s, d, "conversations").select("conv_id", "turn", T.word_set(F.col("text")).alias("w")))
)
query(
    "memory_neighbours",
    "WITH v AS (SELECT vec_id, label, embedding FROM embeddings) SELECT a, b, round(c, 6) AS cosine, cast(r AS int) AS rank FROM (SELECT x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS c, row_number() OVER (PARTITION BY x.vec_id ORDER BY c DESC, y.vec_id) AS r FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE c >= 0.3) WHERE r <= 3",
)(lambda s, d: (lambda v: memory.neighbours(v, v, "label", 3, 0.3).withColumn("cosine", F.round("cosine", 6)))(table(s, d, "embeddings").select("label", F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))))
CONV_SQL = "SELECT concat('c', conv_id) AS trace_id, cast(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS int) AS pos, role AS agent_name, CASE lower(role) WHEN 'user' THEN 'observation' WHEN 'human' THEN 'observation' WHEN 'system' THEN 'run.start' WHEN 'tool' THEN 'tool.result' WHEN 'function' THEN 'tool.result' ELSE 'agent.step' END AS event_type, text AS output, left(first_value(text) OVER (PARTITION BY conv_id ORDER BY CASE WHEN lower(role) IN ('user','human') THEN 0 ELSE 1 END, turn), 300) AS goal FROM conversations"
query("ingest_conversations", f"SELECT * REPLACE (CASE WHEN count(*) FILTER (event_type='observation') OVER (PARTITION BY trace_id) > 0 THEN goal END AS goal) FROM ({CONV_SQL})")(lambda s, d: conversation_runs(table(s, d, "conversations")))


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as message-list payloads, as an export would hold them."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))
    return rows.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("trace_id"), F.parse_json(F.to_json(F.struct("messages"))).alias("payload"))


query("ingest_messages", f"SELECT trace_id, pos, event_type, lower(agent_name) AS agent_name, output FROM ({CONV_SQL})")(lambda s, d: ingest.messages(_payloads(s, d)))
query("ingest_format_detection", "SELECT 'messages' AS format, count(DISTINCT conv_id) AS n FROM conversations")(lambda s, d: _payloads(s, d).select(exports.detect_format().alias("format")).groupBy("format").agg(F.count("*").alias("n")))
query("store_latest_event", "SELECT user_id, max(struct_pack(ts := ts, event_id := event_id)).event_id AS event_id, arg_max(event_type, struct_pack(ts := ts, event_id := event_id)) AS event_type FROM events GROUP BY 1")(
    lambda s, d: ingest.latest(table(s, d, "events").withColumn("o", F.struct("ts", "event_id")), "user_id", "o").select("user_id", "event_id", "event_type")
)
query("store_status_counts", W_EVT + "SELECT event_type, count(*) AS n FROM evt GROUP BY 1")(lambda s, d: _runs(s, d).groupBy("event_type").agg(F.count("*").alias("n")))
query("store_latency_percentiles", W_EVT + "SELECT event_type, median(duration_ms) AS median_ms, quantile_disc(duration_ms, 0.95) AS p95_ms FROM evt GROUP BY 1")(
    lambda s, d: _runs(s, d).groupBy("event_type").agg(F.median("duration_ms").alias("median_ms"), F.expr("percentile_disc(0.95) within group (order by duration_ms)").alias("p95_ms"))
)
