"""Queries of screen runs, judges' answers, cascades and captured logs, with their oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import screens
from ..sources.fixtures import RICH_SQL, table
from ..streaming import capture
from .events import FOUND, W, findings, rich
from .registry import query

C, L = F.col, F.lit


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line per turn: steps, of which some don't parse and some are system errors; the order in the file isn't the steps'."""
    c, t = C("conv_id"), C("turn")
    step = F.to_json(F.struct((L(100) - t).alias("step_num"), C("role").alias("action"), (c % 2 == 0).alias("done"), F.when(c % 3 == 0, 1.0).otherwise(0.0).alias("reward"), F.when(c % 5 == 1, L(" bad ")).alias("error")))
    text = F.when(t % 4 == 3, L("{broken")).when(t % 4 == 2, F.concat(L('{"Error":"sys'), t.cast("string"), L('"}'))).otherwise(step)
    return table(spark, sf_dir, "conversations").select(c.alias("run"), t.alias("line"), F.try_parse_json(text).alias("record"))


_STEPS = "s AS (SELECT conv_id AS run, 100 - turn AS step_num, turn, conv_id % 2 = 0 AS done, CASE WHEN conv_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS reward, CASE WHEN conv_id % 5 = 1 THEN 'bad' END AS error, role FROM conversations WHERE turn % 4 < 2)"
query("screen_steps", f"WITH {_STEPS} SELECT run, cast(step_num AS int) AS step_num, role AS action, done, reward, error, cast(row_number() OVER (PARTITION BY run ORDER BY step_num) AS int) AS ord FROM s")(lambda s, d: screens.steps(_lines(s, d)))
query("screen_run_status", f"WITH {_STEPS}, r AS (SELECT DISTINCT conv_id AS run FROM conversations), l AS (SELECT run, max(step_num) AS step FROM s GROUP BY 1), e AS (SELECT conv_id AS run, concat('sys', min(turn)) AS sys FROM conversations WHERE turn % 4 = 2 GROUP BY 1), x AS (SELECT r.run, l.step, r.run % 2 = 0 AS done, r.run % 3 = 0 AS won, CASE WHEN r.run % 5 = 1 THEN 'bad' END AS error, e.sys FROM r LEFT JOIN l USING (run) LEFT JOIN e USING (run)) SELECT run, CASE WHEN step IS NOT NULL AND done AND won THEN 'success' ELSE 'failure' END AS status, cast(coalesce(step, -1) AS int) AS terminal_step, CASE WHEN step IS NULL THEN coalesce(sys, 'empty trajectory') WHEN done AND won THEN '' ELSE coalesce(error, sys, CASE WHEN NOT done THEN concat('trajectory terminated without done=True at step ', step) ELSE concat('task scored reward=0.0 at step ', step) END) END AS error FROM x")(lambda s, d: screens.run_status(_lines(s, d)))
query("screen_result_classes", "SELECT user_id AS run, CASE user_id % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'failure' ELSE 'skipped' END AS result_class FROM (SELECT DISTINCT user_id FROM events)")(
    lambda s, d: screens.classify(table(s, d, "events").select(C("user_id").alias("run")).distinct().withColumn("result", F.when(C("run") % 4 == 0, " 1.00\n").when(C("run") % 4 == 1, "0.5").when(C("run") % 4 == 2, "n/a")))
)
query("screen_discovered_runs", "SELECT DISTINCT concat('runs/', user_id % 20) AS dir FROM events WHERE user_id % 3 < 2 ORDER BY 1")(
    lambda s, d: table(s, d, "events").select(F.concat(L("runs/"), (C("user_id") % 20).cast("string"), F.when(C("user_id") % 3 == 0, "/traj.jsonl").when(C("user_id") % 3 == 1, "/trajectory.jsonl").otherwise("/other.txt")).alias("path")).where(C("path").rlike(r"/(traj|trajectory)\.jsonl$")).select(F.regexp_replace("path", "/[^/]+$", "").alias("dir")).distinct().orderBy("dir")
)
query("screen_first_per_task", "SELECT doc_id % 50 AS task_id, min(doc_id) AS trial FROM documents GROUP BY 1")(lambda s, d: screens.first_per_task(table(s, d, "documents").select((C("doc_id") % 50).alias("task_id"), C("doc_id").alias("trial"))))
_TAGS = (("G1", "gui.grounding"), ("P1", "gui.perception"), ("R1", "gui.reasoning"))
query("screen_root_of_analysis", W + ", a AS (SELECT trace_id, cast(max(pos) // 4 AS int) AS step, CASE count(*) % 4 WHEN 0 THEN 'G1' WHEN 1 THEN 'P1' WHEN 2 THEN 'R1' ELSE 'Z9' END AS tag FROM rich GROUP BY 1) SELECT trace_id, step, (SELECT arg_min(event_id, pos) FROM rich r WHERE r.trace_id = a.trace_id AND r.step_index = a.step) AS event_id, CASE tag WHEN 'G1' THEN 'gui.grounding' WHEN 'P1' THEN 'gui.perception' WHEN 'R1' THEN 'gui.reasoning' ELSE 'gui.unknown' END AS mode_id FROM a")(
    lambda s, d: (lambda r: screens.root_of_analysis(r.groupBy("trace_id").agg(F.floor(F.max("pos") / 4).cast("int").alias("step"), F.element_at(F.array(L("G1"), L("P1"), L("R1"), L("Z9")), (F.count("*") % 4 + 1).cast("int")).alias("tag")), r, s.createDataFrame(_TAGS, "tag string, mode_id string")))(rich(s, d))
)


def _tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = C("doc_id")
    x = lambda tag, step: F.struct(L(tag).alias("tag"), step.cast("int").alias("step"))
    return table(spark, sf_dir, "labels").select(d.alias("task_id"), F.when(d % 4 == 0, x("F1", d % 3)).alias("final"), F.array(x("H1", F.when(d % 3 > 0, d % 5)), x("H2", F.when(d % 2 > 0, L(2)))).alias("humans"), F.when(d % 7 < 6, x("M1", L(9))).alias("model"))


query("screen_tiered_labels", "SELECT doc_id AS task_id, 'human' AS source, 'F1' AS tag, cast(doc_id % 3 AS int) AS step FROM labels WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id, 'human', 'H1', cast(doc_id % 5 AS int) FROM labels WHERE doc_id % 4 > 0 AND doc_id % 3 > 0 UNION ALL SELECT doc_id, 'human', 'H2', 2 FROM labels WHERE doc_id % 4 > 0 AND doc_id % 2 > 0 UNION ALL SELECT doc_id, 'llm', 'M1', 9 FROM labels WHERE doc_id % 4 > 0 AND doc_id % 3 = 0 AND doc_id % 2 = 0 AND doc_id % 7 < 6")(lambda s, d: screens.tiered_labels(_tiers(s, d)))


def _turn(name: str, sql: str, make, out: str) -> None:
    query(name, f"SELECT conv_id, turn, {sql} AS {out} FROM conversations")(lambda s, d: table(s, d, "conversations").select("conv_id", "turn", make().alias(out)))


_turn("screen_instruction", "CASE turn % 3 WHEN 0 THEN concat('Open the ', role, '.') WHEN 1 THEN 'Done!' ELSE '' END", lambda: screens.instruction(F.when(C("turn") % 3 == 0, F.concat(L(' "open  the '), "role", L("' "))).when(C("turn") % 3 == 1, L("done!"))), "instruction")
_turn("screen_tagged_sections", "CASE WHEN turn % 2 = 0 THEN concat('look at ', role, chr(10), 'hm') ELSE role END", lambda: screens.tagged_sections(F.when(C("turn") % 2 == 0, F.concat(L("[TEXT] look\nat "), "role", L("\n[TOOL_USE] click\n[THINKING] hm\n[OTHER] x"))).otherwise(F.concat(L("junk\n[TEXT]"), "role"))), "sections")
_turn("screen_xml_calls", "concat('function: click', chr(10), 'x: ', turn, chr(10), 'y: 2')", lambda: screens.xml_calls(F.concat(L("<tool_call><function=click><parameter=x>"), C("turn").cast("string"), L("</parameter>\n<parameter=y> 2 </parameter></function></tool_call>"))), "calls")
_turn("screen_moved_click", "CASE turn % 3 WHEN 0 THEN concat('pyautogui.click(', turn, ', 7); x') WHEN 1 THEN concat('pyautogui.scroll(-3, ', turn, ', 7)') ELSE 'pyautogui.click(1, 2)' END", lambda: screens.moved_click(F.when(C("turn") % 3 == 0, L("pyautogui.click(10 , 20); x")).when(C("turn") % 3 == 1, L("pyautogui.scroll(-3, 5, 6)")).otherwise(L("pyautogui.click(1, 2)")), F.when(C("turn") % 3 < 2, C("turn")), L(7)), "code")
_KNOWN = {"planning.loop": "planning", "action.bad": "action"}


def _answers() -> Column:
    t = C("turn") % 7
    return F.when(t == 0, '```json\n{"mode_id": "planning.loop", "confidence": 1.7}\n```').when(t == 1, '{"mode_id": "nope"}').when(t == 2, '{"abstain": true, "abstain_reason": "insufficient_evidence", "confidence": 0.25}').when(t == 3, '{"abstain": true, "abstain_reason": "tired"}').when(t == 4, "no idea").when(t == 5, '{"confidence": "x"}').otherwise('I say {"mode_id": "action.bad"} so')


_turn("judge_classification", "concat_ws('|', " + ", ".join("CASE turn % 7 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(vs)) + " END" for vs in (("", "unknown_mode", "insufficient_evidence", "unparsed", "malformed_response", "unparsed", ""), ("planning.loop", "", "", "", "", "", "action.bad"), ("planning", "", "", "", "", "", "action"), ("1.0", "0.0", "0.25", "0.0", "0.0", "0.0", "0.0"))) + ")", lambda: (lambda r: F.concat_ws("|", F.coalesce(r["abstain_reason"], L("")), F.coalesce(r["mode_id"], L("")), F.coalesce(r["family"], L("")), r["confidence"].cast("string")))(screens.classification(_answers(), _KNOWN)), "answer")

query(
    "diagnose_cascade",
    f"WITH RECURSIVE {RICH_SQL}, {FOUND}, n AS (SELECT trace_id, event_id, step_index AS step, row_number() OVER (PARTITION BY trace_id ORDER BY ordinal) - 1 AS k FROM fnd), e AS (SELECT n.*, p.event_id AS parent FROM n LEFT JOIN n p ON p.trace_id = n.trace_id AND n.k % 10 > 0 AND n.k % 10 < 8 AND p.k = n.k - 1 - n.k % 2), r AS (SELECT trace_id, event_id, step, 0 AS depth, concat(lpad(coalesce(step, 999999999)::VARCHAR, 9, '0'), ':', event_id) AS path FROM e WHERE parent IS NULL AND k % 10 <> 8 UNION ALL SELECT e.trace_id, e.event_id, e.step, r.depth + 1, concat(r.path, '/', lpad(coalesce(e.step, 999999999)::VARCHAR, 9, '0'), ':', e.event_id) FROM e JOIN r ON r.trace_id = e.trace_id AND r.event_id = e.parent), a AS (SELECT e.trace_id, e.event_id, e.step, r.depth, r.path FROM e LEFT JOIN r ON r.trace_id = e.trace_id AND r.event_id = e.event_id) SELECT trace_id, event_id, cast(row_number() OVER (PARTITION BY trace_id ORDER BY path IS NULL, path, step IS NULL, step, event_id) - 1 AS int) AS place, depth FROM a",
)(lambda s, d: screens.cascade(_linked(findings(rich(s, d)))))


def _linked(found: DataFrame) -> DataFrame:
    """Findings that each follow from an earlier one of their run, in short chains; one in ten names a parent that isn't there."""
    w = F.row_number().over(screens.Window.partitionBy("trace_id").orderBy("ordinal")) - 1
    n = found.select("trace_id", "event_id", C("step_index").alias("step"), w.alias("k"))
    p = n.select("trace_id", C("event_id").alias("named"), C("k").alias("up"))
    k = C("k")
    rows = n.withColumn("up", F.when((k % 10 > 0) & (k % 10 < 8), k - 1 - k % 2)).join(p, ["trace_id", "up"], "left")
    return rows.select("trace_id", "event_id", "step", F.when(k % 10 == 8, L("gone")).otherwise(C("named")).alias("parent_id"))


# --- captured logs

def _captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = C("turn")
    body = F.concat(L('{"a":1}\n\n{"t":'), t.cast("string"), L("}\n"), F.when(t % 3 == 1, L("{bad\n")).otherwise(L("")), F.when(t % 2 == 0, L('{"tail"')).otherwise(L("")))
    return table(spark, sf_dir, "conversations").select(F.concat_ws("-", C("conv_id").cast("string"), t.cast("string")).alias("path"), F.encode(body, "UTF-8").alias("content"))


_BODY = "concat('{\"a\":1}', chr(10), chr(10), '{\"t\":', turn, '}', chr(10), CASE WHEN turn % 3 = 1 THEN concat('{bad', chr(10)) ELSE '' END)"
query("capture_snapshots", f"SELECT concat(conv_id, '-', turn) AS path, strlen({_BODY}) AS complete_size, sha256({_BODY}) AS content_sha256, sha256(CASE WHEN turn % 3 = 1 THEN '{{bad' ELSE concat('{{\"t\":', turn, '}}') END) AS last_record_sha256, cast(CASE WHEN turn % 3 = 1 THEN 3 ELSE 2 END AS int) AS n_records, turn % 3 = 1 AS malformed, CASE WHEN turn % 2 = 0 THEN 7 ELSE 0 END AS ignored_tail_bytes FROM conversations".replace("strlen(", "cast(strlen(").replace(") AS complete_size", ") AS int) AS complete_size"))(lambda s, d: capture.snapshots(_captured(s, d)))
query("capture_reconciled", W + ", r AS (SELECT trace_id, event_id, pos, CASE pos % 4 WHEN 0 THEN 'committed' WHEN 1 THEN 'failed' WHEN 2 THEN 'pending' ELSE 'late' END AS status FROM rich WHERE pos < 12), c AS (SELECT trace_id, max(pos) AS newest FROM r WHERE status = 'committed' GROUP BY 1) SELECT event_id AS receipt_id, CASE WHEN status = 'committed' THEN 'done' WHEN pos <= newest THEN 'superseded' ELSE 'replay' END AS decision FROM r LEFT JOIN c USING (trace_id)")(
    lambda s, d: capture.reconcile(rich(s, d).where("pos < 12").select(C("event_id").alias("receipt_id"), C("trace_id").alias("session_id"), C("pos").alias("n_bytes"), F.element_at(F.array(L("committed"), L("failed"), L("pending"), L("late")), (C("pos") % 4 + 1).cast("int")).alias("status")))
)
query("capture_versions", W + ", n AS (SELECT trace_id, event_id, pos FROM rich WHERE pos BETWEEN 5 AND 7) SELECT event_id, CASE WHEN pos = 6 THEN 'accepted' ELSE 'conflict' END AS outcome FROM n WHERE (SELECT count(*) FROM rich x WHERE x.trace_id = n.trace_id AND x.pos < 5) = 5")(
    lambda s, d: (lambda r: capture.version_append(r.where("pos < 5").select(C("trace_id").alias("key"), (C("pos") + 1).alias("version")), r.where("pos between 5 and 7").select(C("trace_id").alias("key"), "event_id", (C("pos") - 1).alias("expected"))).select("event_id", "outcome"))(rich(s, d))
)
