"""Queries of quote location, evidence and validation, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import trace as X
from ..operators import evidence, quotes
from ..sources.fixtures import table
from .events import W, rich
from .registry import query

C, L = F.col, F.lit


def _quotes(runs: DataFrame) -> DataFrame:
    """Quotes of four kinds: as it stands, with other blanks and a truncation mark, with quotation marks, made up."""
    p = C("pos")
    quote = F.when(p % 4 == 0, L("No results")).when(p % 4 == 1, L("the  task ...")).when(p % 4 == 2, L("'JSON' schema in")).otherwise("made up")
    return runs.where("pos % 9 < 4 and pos < 12").select("trace_id", F.concat(L("q"), "event_id").alias("quote_id"), F.when(p % 2 == 0, C("event_id")).alias("anchor"), quote.alias("quote"))


LOC = """q AS (SELECT trace_id, concat('q', event_id) AS quote_id, CASE WHEN pos % 2 = 0 THEN event_id END AS anchor, CASE pos % 4 WHEN 0 THEN 'No results' WHEN 1 THEN 'the task' WHEN 2 THEN 'JSON schema in' ELSE 'made up' END AS quote, pos % 4 AS k FROM rich WHERE pos % 9 < 4 AND pos < 12),
hit AS (SELECT q.trace_id, quote_id, k, arg_min(r.event_id, struct_pack(a := r.event_id IS DISTINCT FROM anchor, b := r.pos)) AS event_id FROM q JOIN rich r ON r.trace_id = q.trace_id AND contains(r.text, quote) GROUP BY ALL),
loc AS (SELECT q.trace_id, q.quote_id, CASE WHEN h.event_id IS NOT NULL THEN ['exact', 'normalized', 'canonical'][q.k + 1] END AS rung, h.event_id, cast(CASE WHEN q.k = 0 AND h.event_id IS NOT NULL THEN 1 END AS int) AS "at" FROM q LEFT JOIN hit h USING (trace_id, quote_id))"""
query("evidence_located", W + f", {LOC} SELECT * FROM loc")(lambda s, d: (lambda r: evidence.locate(_quotes(r), r))(rich(s, d)))
query("evidence_grounding", W + f", {LOC}, bl AS (SELECT trace_id, event_id AS blamed_id, step_index AS bs, pos AS bp FROM rich WHERE pos = 8) SELECT loc.trace_id, quote_id, CASE WHEN dd < 0 THEN 'before' WHEN dd = 0 THEN 'at' WHEN dd > 0 THEN 'after' END AS position, dd <= 0 AS grounded FROM (SELECT loc.*, coalesce(r.step_index - bs, r.pos - bp) AS dd FROM loc JOIN bl USING (trace_id) LEFT JOIN rich r ON r.trace_id = loc.trace_id AND r.event_id = loc.event_id) loc")(
    lambda s, d: (lambda r: evidence.grounding(evidence.locate(_quotes(r), r), r, r.where("pos = 8").select("trace_id", C("event_id").alias("blamed_id"))))(rich(s, d))
)
query("evidence_valid", W + ", c AS (SELECT trace_id, event_id AS qid, CASE WHEN pos % 2 = 0 THEN event_id END AS cited, CASE WHEN pos % 3 = 0 THEN 'No results' ELSE 'JSON schema' END AS quote FROM rich WHERE pos < 10), m AS (SELECT c.trace_id, qid, cited, quote, r.event_id, count(*) OVER (PARTITION BY c.trace_id, qid) AS n FROM c JOIN rich r ON r.trace_id = c.trace_id AND contains(r.text, quote) AND (cited IS NULL OR cited = r.event_id)) SELECT DISTINCT trace_id, event_id, quote FROM m WHERE cited IS NOT NULL OR n = 1")(
    lambda s, d: (lambda r: evidence.valid_evidence(r.where("pos < 10").select("trace_id", C("event_id").alias("quote_id"), F.when(C("pos") % 2 == 0, C("event_id")).alias("event_id"), F.when(C("pos") % 3 == 0, L(" No  results")).otherwise(L("JSON schema")).alias("quote")), r))(rich(s, d))
)


#: Turns whose texts have single blanks only, as runs: places in the normalised text are places in the source.
_PLAIN = "length(text) >= 80 AND NOT regexp_matches(text, '\\s\\s') AND text = trim(text)"
_PIECE = "trim(regexp_replace(substr(text, 11, 40), '\\s+', ' ', 'g'))"
TURNS = f"""ev AS (SELECT conv_id AS trace_id, concat('evt_', conv_id, '_', turn) AS event_id, turn, text, regexp_replace(text, '\\s', ' ', 'g') AS n, {_PIECE} AS piece FROM conversations WHERE {_PLAIN}),
asked AS (SELECT *, turn % 5 AS kind, length(piece) AS k FROM ev WHERE length(piece) > 30),
held AS (SELECT a.trace_id, a.turn, arg_min(struct_pack(e := e.event_id, at := CASE WHEN a.kind = 1 AND contains(e.text, a.piece) THEN instr(e.text, a.piece) ELSE instr(e.n, a.piece) END - 1, raw := contains(e.text, a.piece)), struct_pack(r := a.kind = 1 AND NOT contains(e.text, a.piece), o := a.kind <> 2 OR e.event_id <> a.event_id, t := e.turn)) AS h FROM asked a JOIN ev e ON e.trace_id = a.trace_id AND contains(e.n, a.piece) GROUP BY ALL)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where((F.char_length("text") >= 80) & ~C("text").rlike(r"\s\s") & (C("text") == F.trim("text")))
    return rows.select(C("conv_id").alias("trace_id"), F.concat_ws("_", L("evt"), "conv_id", "turn").alias("event_id"), C("turn").alias("pos"), "text")


def asked(runs: DataFrame) -> DataFrame:
    """Quotes of the turns' own passages: with blanks doubled, in a frame with marks, named by their event, with a letter changed, and made up."""
    p = C("piece")
    rows = runs.withColumn("piece", F.trim(F.regexp_replace(F.substring("text", 11, 40), r"\s+", " "))).where(F.char_length("piece") > 30).withColumn("kind", C("pos") % 5)
    changed = F.concat(F.substring(p, 1, 19), L("#"), F.substring(p, L(21), F.char_length(p)))
    quote = F.when(C("kind") == 0, F.replace(p, L(" "), L("  "))).when(C("kind") == 1, F.concat(L("step 3: Observation: \""), p, L("\""))).when(C("kind") == 2, F.concat(C("event_id"), L(": "), p, L(" ..."))).when(C("kind") == 3, changed).otherwise(L("[step 4] evt_none: never said by anyone here"))
    return rows.select("trace_id", F.concat(L("q"), "event_id").alias("quote_id"), L(None).cast("string").alias("anchor"), quote.alias("quote"), "kind")


query("quotes_placed", f"WITH {TURNS} SELECT trace_id, concat('q', event_id) AS quote_id, CASE WHEN kind = 4 THEN 'unresolvable' WHEN kind = 3 THEN 'similar' WHEN kind = 1 AND h.raw THEN 'exact' ELSE 'normalized' END AS rung, CASE WHEN kind < 4 THEN h.e END AS event_id, CASE WHEN kind < 4 THEN h.at::INT END AS start, CASE WHEN kind < 4 THEN (h.at + k)::INT END AS stop, CASE WHEN kind < 4 THEN piece END AS found, CASE WHEN kind < 3 THEN 1.0::DOUBLE WHEN kind = 3 THEN round(2.0::DOUBLE * (k - 1) / (2 * k), 6) END AS similarity, CASE WHEN kind = 2 THEN CASE WHEN h.e = event_id THEN 'resolved' ELSE 'elsewhere' END WHEN kind = 4 THEN 'unknown_event' ELSE 'not_declared' END AS anchor_state FROM asked JOIN held USING (trace_id, turn)")(
    lambda s, d: (lambda r: quotes.place(asked(r), r, 0.85).select("trace_id", "quote_id", "rung", "event_id", "start", "stop", F.regexp_replace("found", r"\s", " ").alias("found"), F.round("similarity", 6).alias("similarity"), "anchor_state"))(turns(s, d))
)
query("quotes_frames", f"WITH {TURNS} SELECT trace_id, concat('q', event_id) AS quote_id, CASE kind WHEN 2 THEN event_id WHEN 4 THEN 'evt_none' END AS declared, CASE kind WHEN 0 THEN replace(piece, ' ', '  ') WHEN 1 THEN piece WHEN 2 THEN concat(piece, ' ...') WHEN 3 THEN concat(left(piece, 19), '#', substr(piece, 21)) ELSE 'never said by anyone here' END AS content FROM asked")(
    lambda s, d: asked(turns(s, d)).select("trace_id", "quote_id", quotes.framed(C("quote"))["declared"].alias("declared"), quotes.framed(C("quote"))["content"].alias("content"))
)
query("evidence_safe_details", W + "SELECT event_id, concat('type=', event_type) AS details FROM rich")(lambda s, d: rich(s, d).select("event_id", F.array_join(F.transform(F.map_entries(evidence.safe_details(F.create_map(L("Path"), L("/x"), L("type"), C("event_type"), L("uri"), L("u")))), lambda e: F.concat(e["key"], L("="), e["value"])), ",").alias("details")))
query("labels_annotation_filter", "SELECT doc_id AS task_id FROM documents WHERE source IN ('src0', 'src1', 'src2') AND contains(lower(text), 'the') AND doc_id NOT IN (SELECT doc_id FROM labels)")(
    lambda s, d: evidence.annotation_filter(table(s, d, "documents").select(C("doc_id").alias("task_id"), C("source").alias("app"), "text"), apps=("src0", "src1", "src2"), contains="The", done=table(s, d, "labels").select(C("doc_id").alias("task_id")), annotated=False).select("task_id")
)


def _turn(name: str, sql: str, make, out: str) -> None:
    query(name, f"SELECT conv_id, turn, {sql} AS {out} FROM conversations")(lambda s, d: table(s, d, "conversations").select("conv_id", "turn", make().alias(out)))


_LIVE = ('{"mode":"dry"}', '{"mode":"live"}', '{"mode":"live","observed":true}', '{"mode":"live","observed":true,"runner":"r"}', '{"mode":"live","observed":true,"runner":"r","framework":"f","external_calls":-1}', '{"mode":"live","observed":true,"runner":"r","framework":"f","external_calls":0}', '{"mode":"live","observed":false,"runner":"r","framework":"f","external_calls":0,"events":[]}', '{"mode":"live","observed":true,"runner":"r","framework":"f","external_calls":2,"events":[{"event_type":"tool.call"}]}', '{"mode":"live","observed":true,"runner":"r","framework":"f","external_calls":1,"events":[{"event_type":"tool.call"}]}')
_WHY = ("mode", "observed flag", "runner", "framework", "count", "flag and count", "no events", "fewer calls than declared", None)
_turn("rerun_live_validation", "CASE turn % 9 " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(_WHY) if w) + " END", lambda: evidence.live_result(F.parse_json(F.element_at(F.array(*map(L, _LIVE)), (C("turn") % 9 + 1).cast("int")))), "reason")
_turn("screen_known_tag", "CASE turn % 3 WHEN 0 THEN 'G1' WHEN 1 THEN 'P2' END", lambda: evidence.known_tag(F.when(C("turn") % 3 == 0, " G1").when(C("turn") % 3 == 1, "Vision").otherwise("Z"), ("G1", "P2"), {"Vision": "P2"}), "tag")
_turn("ingest_upload_id", "CASE turn % 3 WHEN 0 THEN concat('c_', conv_id) WHEN 1 THEN role END", lambda: F.regexp_replace(F.coalesce(F.when(C("turn") % 3 == 0, F.concat(L("c/"), C("conv_id").cast("string"))), F.when(C("turn") % 3 == 1, C("role"))), "[^A-Za-z0-9._-]+", "_"), "upload_id")
query("store_snapshot_digest", W + "SELECT trace_id, sha256(concat('[', string_agg(concat('\"', event_id, '\"'), ',' ORDER BY pos), ']')) AS digest FROM rich GROUP BY 1")(lambda s, d: rich(s, d).groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "event_id"))), lambda x: x["event_id"]).alias("ids")).select("trace_id", X.fingerprint(F.parse_json(F.to_json("ids"))).alias("digest")))
query("ingest_expand_batch", "SELECT cast(conv_id AS varchar) AS file, cast(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS int) AS index, CASE WHEN turn % 5 = 2 THEN 'not JSON' END AS error FROM conversations WHERE turn % 5 <> 4")(
    lambda s, d: evidence.expand_batch(table(s, d, "conversations").select(C("conv_id").cast("string").alias("file"), C("turn").alias("line"), F.when(C("turn") % 5 == 2, "{x").when(C("turn") % 5 == 4, "  ").otherwise('{"a": 1}').alias("value"))).select("file", "index", "error")
)
for _name, _wanted, _state, _n in (("found", "row-3", "found", 3), ("missing", "nope", "not found", None), ("ambiguous", "en", "ambiguous", None)):
    query(f"ingest_select_row_{_name}", f"WITH r AS (SELECT doc_id AS n, concat('d', doc_id) AS a, lang AS b FROM documents), f AS (SELECT * FROM r WHERE a = '{_wanted}' OR coalesce(b = '{_wanted}', false) OR concat('row-', n) = '{_wanted}') SELECT CASE WHEN count(*) = 0 THEN 'not found' WHEN count(*) = 1 THEN 'found' ELSE 'ambiguous' END AS state, min(n) AS n, count(*) AS candidates FROM f")(
        lambda s, d, w=_wanted: evidence.select_row(table(s, d, "documents").select(C("doc_id").alias("n"), F.concat(L("d"), C("doc_id").cast("string")).alias("trajectory_id"), C("lang").alias("task_id")), w)
    )
