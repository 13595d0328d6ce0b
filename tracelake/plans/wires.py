"""Queries of tool-calling protocol checks and of stores, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import protocol, stores
from ..sources.fixtures import RICH_SQL, table
from .events import FOUND, W, rich
from .registry import query
from .views import ADV, advised

C, L = F.col, F.lit


# --- the wire: every fifth turn calls a tool, in several broken ways by conversation

def wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = C("conv_id"), C("turn")
    k, own = t % 5, F.concat(L("k"), t.cast("string"))
    ids = F.when(c % 4 == 1, F.array(own, own)).when(c % 9 == 4, F.array(L(""))).otherwise(F.array(own))
    call = k == 1
    answer = F.when(c % 3 == 1, L("zzz")).otherwise(F.concat(L("k"), (t - 1).cast("string")))
    role = F.when(k.isin(1, 3), "assistant").when((k == 2) | ((k == 4) & (c % 2 == 0)), "tool").otherwise("user")
    return table(spark, sf_dir, "conversations").select(
        F.concat(L("c"), c.cast("string")).alias("trace_id"), t.alias("idx"), role.alias("role"), F.when(call, c % 11 != 5).alias("is_list"), F.when(call & (c % 11 != 5), ids).otherwise(F.array().cast("array<string>")).alias("ids"),
        F.when(call, F.transform(ids, lambda _: L("sh"))).alias("names"), F.when(call, F.transform(ids, lambda _: F.when(c % 10 == 7, L("[1]")).otherwise(L('{"a":1}')))).alias("args"), F.when(role == "tool", answer).alias("tool_call_id"),
    )


def executed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = C("conv_id"), C("turn")
    n = L(None).cast("string")
    own = F.concat(L("k"), t.cast("string"))
    e = lambda kind, pointer, call_id, tool, args, error, envelope: F.struct(kind.alias("event_type"), pointer.alias("pointer"), call_id.alias("call_id"), tool.alias("tool"), args.alias("args"), error.alias("error"), envelope.alias("envelope"))
    null = L(None).cast("long")
    refused = c % 4 == 1
    turn = e(F.when(refused, "error").otherwise("agent.step"), F.when(c % 5 != 2, t), n, n, n, F.when(refused & (c % 8 == 1), L("multiple_tool_calls: 2")), F.when(c % 13 == 6, L(protocol.FALLBACK)))
    call = e(L("tool.call"), null, F.when(c % 13 == 6, n).when(c % 7 == 3, L("other")).otherwise(own), F.when(c % 6 == 1, L("ls")).otherwise(L("sh")), F.when(c % 8 == 5, L('{"a":2}')).otherwise(L('{"a":1}')), n, n)
    result = F.when(c % 12 != 8, e(L("tool.result"), null, n, L("sh"), n, n, n))
    rows = table(spark, sf_dir, "conversations").where("turn % 5 = 1").select(F.concat(L("c"), c.cast("string")).alias("trace_id"), t.alias("step_index"), F.explode(F.array_compact(F.array(turn, call, result))).alias("e"))
    return rows.select("trace_id", "step_index", "e.*")


_WIRE = """w AS (SELECT concat('c', conv_id) AS trace_id, conv_id AS c, turn AS idx, turn % 5 AS k, CASE WHEN turn % 5 = 2 OR (turn % 5 = 4 AND conv_id % 2 = 0) THEN 'tool' WHEN turn % 5 IN (1, 3) THEN 'assistant' ELSE 'user' END AS role, concat('k', turn) AS own, CASE WHEN conv_id % 3 = 1 THEN 'zzz' ELSE concat('k', turn - 1) END AS answer FROM conversations),
b AS (SELECT *, sum((role <> 'tool')::int) OVER (PARTITION BY trace_id ORDER BY idx) AS block FROM w),
t AS (SELECT b.*, c % 11 <> 5 AS is_list, c % 4 = 1 AS twice, c % 4 <> 1 AND c % 9 = 4 AS blank, coalesce((SELECT list(x.answer ORDER BY x.answer) FROM b x WHERE x.trace_id = b.trace_id AND x.block = b.block AND x.role = 'tool'), []) AS answers FROM b WHERE k = 1)"""
query(
    "protocol_messages",
    f"WITH {_WIRE} SELECT trace_id, idx, 'tool_calls_not_list' AS reason FROM t WHERE NOT is_list UNION ALL SELECT trace_id, idx, 'call_id_missing' FROM t WHERE is_list AND blank UNION ALL SELECT trace_id, idx, 'call_ids_not_unique' FROM t WHERE is_list AND twice UNION ALL SELECT trace_id, idx, 'calls_not_answered_once' FROM t WHERE is_list AND NOT blank AND answers <> CASE WHEN twice THEN [own, own] ELSE [own] END UNION ALL SELECT b.trace_id, b.idx, 'orphan_tool_message' FROM b WHERE role = 'tool' AND NOT EXISTS (SELECT 1 FROM t WHERE t.trace_id = b.trace_id AND t.block = b.block AND is_list)",
)(lambda s, d: protocol.message_violations(wire(s, d)))
query(
    "protocol_executions",
    f"WITH {_WIRE}, v AS (SELECT trace_id, idx, c, twice, c % 5 <> 2 AS one, CASE WHEN c % 12 = 8 THEN 0 ELSE 1 END AS results, CASE WHEN c % 13 = 6 THEN NULL WHEN c % 7 = 3 THEN 'other' ELSE own END AS ran_id, own FROM t WHERE is_list AND NOT blank) SELECT trace_id, idx, unnest(list_filter([CASE WHEN NOT one THEN 'no_unique_turn_pointer' END, CASE WHEN one AND twice AND c % 8 <> 1 THEN 'multi_call_not_rejected' END, CASE WHEN one AND twice AND c % 8 = 1 THEN 'rejected_call_executed' END, CASE WHEN one AND NOT twice AND results = 0 THEN 'no_unique_execution_pair' END, CASE WHEN p AND ran_id IS DISTINCT FROM own THEN 'call_id_disagrees' END, CASE WHEN p AND c % 6 = 1 THEN 'call_name_disagrees' END, CASE WHEN p AND c % 10 = 7 THEN 'args_not_object' END, CASE WHEN p AND c % 10 <> 7 AND c % 8 = 5 THEN 'call_args_disagree' END, CASE WHEN p AND c % 6 = 1 THEN 'result_name_disagrees' END], lambda x: x IS NOT NULL)) AS reason FROM (SELECT *, one AND NOT twice AND results = 1 AS p FROM v)",
)(lambda s, d: protocol.execution_violations(wire(s, d), executed(s, d)))
query("protocol_events", f"WITH {_WIRE}, i AS (SELECT DISTINCT trace_id, own FROM t WHERE is_list AND NOT blank) SELECT trace_id, idx, 'call_id_without_envelope' AS reason FROM t WHERE c % 13 <> 6 AND (trace_id, CASE WHEN c % 7 = 3 THEN 'other' ELSE own END) NOT IN (SELECT trace_id, own FROM i) UNION ALL SELECT trace_id, idx, 'call_without_id_or_fallback' FROM t WHERE c % 13 = 6 AND c % 4 = 1")(lambda s, d: protocol.event_violations(wire(s, d), executed(s, d)))

# --- stores

query("store_last_written", W + "SELECT trace_id, arg_max(event_id, pos) AS event_id, arg_max(event_type, pos) AS event_type, max(pos) AS pos FROM rich GROUP BY 1")(lambda s, d: stores.last_written(rich(s, d).select("trace_id", "event_id", "event_type", "pos"), "trace_id", "pos"))
query("store_upsert", W + ", o AS (SELECT trace_id, step_index, max(pos) AS updated_at, 'old' AS version FROM rich WHERE pos < 30 AND step_index IS NOT NULL GROUP BY ALL), n AS (SELECT trace_id, step_index, max(pos) AS updated_at, 'new' AS version FROM rich WHERE pos % 4 = 0 AND step_index IS NOT NULL GROUP BY ALL) SELECT * FROM o WHERE (trace_id, step_index) NOT IN (SELECT trace_id, step_index FROM n) UNION ALL SELECT * FROM n")(
    lambda s, d: (lambda r: stores.upsert(r.where("pos < 30").groupBy("trace_id", "step_index").agg(F.max("pos").alias("updated_at")).withColumn("version", L("old")), r.where("pos % 4 = 0").select("trace_id", "step_index", C("pos").alias("updated_at"), L("new").alias("version")), "trace_id", "step_index"))(rich(s, d).where("step_index is not null"))
)
query("store_newest_first", W + "SELECT trace_id, n, cast(row_number() OVER (ORDER BY n DESC, trace_id) - 1 AS int) AS place FROM (SELECT trace_id, count(*) AS n FROM rich GROUP BY 1)")(lambda s, d: stores.newest_first(rich(s, d).groupBy("trace_id").agg(F.count("*").alias("n")), "n", "trace_id"))
query("store_page", W + "SELECT trace_id AS discussion, pos AS sequence, event_id FROM rich WHERE pos BETWEEN 11 AND 15")(lambda s, d: stores.page(rich(s, d).select(C("trace_id").alias("discussion"), C("pos").alias("sequence"), "event_id"), 10, 5))
query("store_next_sequence", W + "SELECT event_id, cast(coalesce((SELECT max(pos) FROM rich o WHERE o.trace_id = r.trace_id AND o.pos < 20 AND o.pos % 2 = 0), 0) + row_number() OVER (PARTITION BY trace_id ORDER BY pos) AS int) AS sequence FROM rich r WHERE pos >= 20")(
    lambda s, d: (lambda r: stores.next_sequence(r.where("pos < 20 and pos % 2 = 0").select("trace_id", C("pos").alias("sequence")), r.where("pos >= 20"), "trace_id", "pos").select("event_id", "sequence"))(rich(s, d))
)
_STATES = "CASE WHEN page_id % 6 = 0 THEN 'failed' WHEN page_id % 2 = 1 THEN 'imported' WHEN page_id % 4 = 0 THEN 'skipped' ELSE 'updated' END"


def _imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    mark = lambda salt: F.sha2(F.concat(C("url"), salt), 256)
    stored = pages.where("page_id % 2 = 0").select(C("page_id").alias("id"), mark(F.when(C("page_id") % 4 == 0, "").otherwise("old")).alias("fingerprint"))
    return stores.import_sync(stored, pages.select(C("page_id").alias("id"), F.when(C("page_id") % 6 > 0, mark(L(""))).alias("fingerprint")))


query("store_import_sync", f"SELECT page_id AS id, {_STATES} AS state FROM pages")(_imports)
query("store_import_counts", f"SELECT {_STATES} AS state, count(*) AS n FROM pages GROUP BY 1")(lambda s, d: _imports(s, d).groupBy("state").agg(F.count("*").alias("n")))
query("store_batch_totals", "SELECT source AS batch, count(*) AS total, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed, CASE WHEN bool_and(ok) THEN 'completed' WHEN NOT bool_or(ok) THEN 'failed' ELSE 'partial' END AS state FROM (SELECT source, n_chars > 60 AS ok FROM documents WHERE n_chars IS NOT NULL AND source IS NOT NULL) GROUP BY 1")(lambda s, d: stores.batch_totals(table(s, d, "documents").where("n_chars is not null and source is not null").select(C("source").alias("batch"), (C("n_chars") > 60).alias("ok"))))
_REPORTS = "rep AS (SELECT trace_id, concat('r', event_id) AS report_id, pos AS generated_at, pos % 2 = 0 AS parse_error FROM rich WHERE pos % 9 = 5 AND cast(substr(trace_id, 2) AS bigint) % 5 > 0)"


def _reports(runs: DataFrame) -> DataFrame:
    return runs.where("pos % 9 = 5 and cast(substr(trace_id, 2) as bigint) % 5 > 0").select("trace_id", F.concat(L("r"), "event_id").alias("report_id"), C("pos").alias("generated_at"), (C("pos") % 2 == 0).alias("parse_error"))


query("store_latest_report", W + f", {_REPORTS} SELECT t.trace_id, r.id AS report_id, CASE WHEN r.id IS NULL THEN 'not_run' WHEN r.bad THEN 'parse_error' ELSE 'ready' END AS state FROM (SELECT DISTINCT trace_id FROM rich) t LEFT JOIN (SELECT trace_id, arg_max(report_id, struct_pack(a := generated_at, b := report_id)) AS id, arg_max(parse_error, struct_pack(a := generated_at, b := report_id)) AS bad FROM rep GROUP BY 1) r USING (trace_id)")(lambda s, d: (lambda r: stores.with_report(r, _reports(r)))(rich(s, d)))
query("store_memory_join", W + "SELECT e.event_id AS episode_id, e.pos AS created, s.text AS description, p.error AS advice FROM (SELECT * FROM rich ORDER BY pos DESC, event_id DESC LIMIT 200) e LEFT JOIN (SELECT event_id, text FROM rich WHERE pos % 2 = 0) s USING (event_id) LEFT JOIN (SELECT event_id, error FROM rich WHERE pos % 3 = 0) p USING (event_id)")(
    lambda s, d: (lambda r: stores.memory_join(r.select(C("event_id").alias("episode_id"), C("pos").alias("created")), r.where("pos % 2 = 0").select(C("event_id").alias("episode_id"), C("text").alias("description")), r.where("pos % 3 = 0").select(C("event_id").alias("episode_id"), C("error").alias("advice"))))(rich(s, d))
)
query("store_memory_rows", ADV + "SELECT trace_id, (SELECT string_agg(mode_id, ' | ' ORDER BY o) FROM (SELECT mode_id, min(ordinal) AS o FROM a x WHERE x.trace_id = a.trace_id GROUP BY 1)) AS description, coalesce((SELECT string_agg(suggestion, ' | ' ORDER BY o) FROM (SELECT suggestion, min(ordinal) AS o FROM a x WHERE x.trace_id = a.trace_id AND suggestion IS NOT NULL GROUP BY 1)), '') AS suggestions FROM a GROUP BY trace_id")(lambda s, d: stores.memory_rows(advised(rich(s, d))))
query("store_unknown_citations", W + "SELECT DISTINCT trace_id, concat(event_id, 'x') AS event_id FROM rich WHERE pos % 8 = 3")(lambda s, d: (lambda r: stores.unknown_citations(r.where("pos % 4 = 3").select("trace_id", F.when(C("pos") % 8 == 3, F.concat("event_id", L("x"))).otherwise(C("event_id")).alias("event_id")), r))(rich(s, d)))
query("store_receipt_statuses", "SELECT CASE WHEN n > 1 AND last = 'error' THEN 'failed' WHEN n > 3 THEN 'committed' ELSE 'pending' END AS status, count(*) AS n FROM (SELECT user_id, cast(ts AS date) AS day, count(*) AS n, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS last FROM events GROUP BY ALL) GROUP BY 1")(
    lambda s, d: table(s, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last")).select(F.when((C("n") > 1) & (C("last") == "error"), "failed").when(C("n") > 3, "committed").otherwise("pending").alias("status")).groupBy("status").agg(F.count("*").alias("n"))
)
query("store_token_usage", "SELECT role, sum(length(text))::BIGINT AS prompt, sum(turn)::BIGINT AS completion, sum(length(text) + turn)::BIGINT AS total FROM conversations GROUP BY 1")(lambda s, d: table(s, d, "conversations").groupBy("role").agg(F.sum(F.char_length("text")).alias("prompt"), F.sum("turn").alias("completion"), F.sum(F.char_length("text") + C("turn")).alias("total")))
query("overview_frameworks", W + "SELECT framework, count(*) AS n FROM (SELECT DISTINCT trace_id, framework FROM rich) GROUP BY 1 ORDER BY n DESC, framework LIMIT 6")(lambda s, d: rich(s, d).select("trace_id", "framework").distinct().groupBy("framework").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "framework").limit(6))
