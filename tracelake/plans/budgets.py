"""Queries of budgeted views, narrowed blame, drift, mended JSON and mixed folders, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import repair
from ..functions.text import cosine
from ..operators import assembly, leaders, lessons, screens
from ..sources import folders
from ..sources.fixtures import table
from .events import W, rich
from .registry import query

C, L = F.col, F.lit

# --- budgeted views: every state of the plain loop is listed, and the first one within the cap is taken


def _states(blocks: str, cap: int) -> str:
    return f"""b AS ({blocks}), v AS (SELECT *, coalesce(length(brief), length("full")) AS nb, length("full") AS nf, count(*) OVER p AS n, row_number() OVER (PARTITION BY trace_id, focus ORDER BY pos = focus, abs(pos - focus) DESC, pos) AS k FROM b WINDOW p AS (PARTITION BY trace_id, focus)),
turn AS (SELECT DISTINCT trace_id, focus, n, unnest(range(0, 2 * n - 1)) AS s FROM v),
size AS (SELECT t.trace_id, t.focus, t.s, any_value(t.n) AS n, sum(CASE WHEN k <= s // 2 THEN 0 WHEN k = s // 2 + 1 AND s % 2 = 1 THEN nb + 2 ELSE nf + 2 END) - 2 AS total FROM turn t JOIN v USING (trace_id, focus) GROUP BY ALL),
stop AS (SELECT trace_id, focus, coalesce(min(s) FILTER (total <= {cap}), max(s)) AS s FROM size GROUP BY ALL),
seen AS (SELECT trace_id, focus, string_agg(CASE WHEN k = s // 2 + 1 AND s % 2 = 1 THEN coalesce(brief, "full") ELSE "full" END, chr(10) || chr(10) ORDER BY pos) FILTER (k > s // 2) AS body, any_value(s // 2) AS dropped FROM v JOIN stop USING (trace_id, focus) GROUP BY ALL),
shown AS (SELECT trace_id, focus, concat(body, CASE WHEN dropped > 0 THEN concat(chr(10), chr(10), '--- ', dropped, ' more step(s) omitted to fit the context budget ---') ELSE '' END) AS text, dropped FROM seen)"""


def _blocks(runs: DataFrame) -> DataFrame:
    focus = runs.where("pos % 20 = 10").select("trace_id", C("pos").alias("focus"))
    rows = focus.join(runs.select("trace_id", "pos", "event_type", "text"), "trace_id").where("pos <= focus")
    head = F.concat(L("["), C("pos").cast("string"), L("] "))
    brief = F.concat(head, F.substring("text", 1, 8))
    near = C("focus") - C("pos") <= 5
    return rows.select("trace_id", "focus", "pos", F.when(near, F.concat(head, "event_type", L(" "), "text")).otherwise(brief).alias("full"), F.when(near, brief).alias("brief"))


_BLOCKS = """SELECT r.trace_id, focus, pos, CASE WHEN focus - pos <= 5 THEN concat('[', pos, '] ', event_type, ' ', text) ELSE concat('[', pos, '] ', left(text, 8)) END AS "full", CASE WHEN focus - pos <= 5 THEN concat('[', pos, '] ', left(text, 8)) END AS brief FROM rich r JOIN (SELECT trace_id, pos AS focus FROM rich WHERE pos % 20 = 10) f ON f.trace_id = r.trace_id AND pos <= focus"""
for _cap in (90, 300):
    query(f"view_budget_{_cap}", W + f", {_states(_BLOCKS, _cap)} SELECT * FROM shown")(lambda s, d, cap=_cap: assembly.assemble(_blocks(rich(s, d)), cap))

_HEAD = "concat('--- step=', pos, ' ---')"
_CHUNK = f"""SELECT trace_id, 10 AS focus, pos, CASE WHEN pos BETWEEN 8 AND 12 THEN concat({_HEAD}, chr(10), text) ELSE concat('--- step=', pos, ' CONTEXT-ONLY ---', chr(10), left(text, 5)) END AS "full", CASE WHEN pos BETWEEN 8 AND 12 THEN concat({_HEAD}, chr(10), left(text, 5)) END AS brief FROM rich WHERE trace_id IN (SELECT trace_id FROM rich WHERE pos = 8)"""
query("view_chunk_context", W + f", {_states(_CHUNK, 260)}, st AS (SELECT trace_id, arg_min(coalesce(step_index, pos), pos) AS low, arg_max(coalesce(step_index, pos), pos) AS high FROM rich WHERE pos BETWEEN 8 AND 12 GROUP BY 1) SELECT trace_id, focus, concat('You are judging steps ', low, ' to ', high, ' of this run. Steps marked CONTEXT-ONLY are context and never the failing step.', chr(10), chr(10), text) AS text, dropped FROM shown JOIN st USING (trace_id)")(
    lambda s, d: (lambda r: assembly.chunk_view(r, r.where("pos = 8").select("trace_id", L(8).alias("lo"), L(12).alias("hi")), F.concat(L("--- step="), C("pos").cast("string"), L(" ---")), C("text"), F.substring("text", 1, 5), 260))(rich(s, d))
)

# --- narrowing: a judge that knows each run's step, is unsure of some ranges and silent on some

_STEPS = "st AS (SELECT trace_id, list_sort(list(DISTINCT step_index)) AS steps FROM rich WHERE step_index IS NOT NULL GROUP BY 1), tg AS (SELECT *, len(steps) - 1 AS top, len(steps) // 3 AS t, cast(substr(trace_id, 2) AS bigint) AS u FROM st)"


def _answers(runs: DataFrame) -> DataFrame:
    """What the judge says of every range that halving can reach."""
    steps = runs.where("step_index is not null").groupBy("trace_id").agg(F.array_sort(F.collect_set("step_index")).alias("steps"))
    level = steps.select("trace_id", "steps", L(0).alias("lo"), (F.size("steps") - 1).alias("hi"))
    out = None
    for _ in range(12):
        mid = F.floor((C("lo") + C("hi")) / 2).cast("int")
        level = level.where("hi > lo").withColumn("mid", mid)
        out = level if out is None else out.unionByName(level)
        level = level.select("trace_id", "steps", F.inline(F.array(F.struct(C("lo"), C("mid").alias("hi")), F.struct((C("mid") + 1).alias("lo"), C("hi")))))
    user = F.substring("trace_id", 2, 20).cast("long")
    target = F.floor(F.size("steps") / 3)
    half = F.when((user % 5 == 0) & (C("hi") - C("lo") < 6), "both").when(target <= C("mid"), "upper").otherwise(" LOWER")
    return out.select("trace_id", F.get("steps", C("lo")).alias("low"), F.get("steps", C("hi")).alias("high"), half.alias("half"), F.when(user % 2 == 0, 0.9).when(user % 3 == 0, 0.6).alias("confidence"))


def _narrowed(floor: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        runs = rich(spark, sf_dir)
        picks = runs.where("step_index is not null").groupBy("trace_id").agg((F.max("step_index") % 9).cast("int").alias("step"))
        return assembly.narrow(runs, _answers(runs), picks, **({"window": 3, "floor": 0.75} if floor else {"window": 6, "floor": None, "rounds": 8}))

    return run


_MOVE = "CASE WHEN u % 5 = 0 AND hi - lo < 6 THEN 'stop' WHEN t <= (lo + hi) // 2 THEN 'upper' ELSE 'lower' END"


def _bisected(window: int, floor: bool, rounds: int) -> str:
    go = f"SELECT trace_id, steps, t, u, CASE WHEN half = 'lower' THEN (lo + hi) // 2 + 1 ELSE lo END, CASE WHEN half = 'upper' THEN (lo + hi) // 2 ELSE hi END, n + 1, half = 'stop', half <> 'stop' FROM (SELECT *, {_MOVE} AS half FROM"
    last = "SELECT * FROM {} QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY n DESC, done DESC) = 1"
    sure = "(NOT said OR u % 2 = 0)" if floor else "false"
    return f"""{_STEPS}, r(trace_id, steps, t, u, lo, hi, n, done, said) AS (SELECT trace_id, steps, t, u, 0::BIGINT, top::BIGINT, 0, false, false FROM tg UNION ALL {go} r) WHERE NOT done AND hi - lo + 1 > {window} AND n < {rounds}),
e1 AS ({last.format('r')}), told AS (SELECT e1.* EXCLUDE (said), n - done::INT > 0 AS said FROM e1),
q(trace_id, steps, t, u, lo, hi, n, done, said) AS (SELECT trace_id, steps, t, u, lo, hi, n, false, said FROM told WHERE {sure} AND hi > lo UNION ALL {go} q) WHERE NOT done AND hi > lo), e2 AS ({last.format('q')}),
pk AS (SELECT trace_id, max(step_index) % 9 AS pick FROM rich WHERE step_index IS NOT NULL GROUP BY 1), w AS (SELECT a.*, a.steps[a.lo + 1:a.hi + 1] AS left_, b.lo AS lo2, b.hi AS hi2, b.n AS n2, pick FROM told a LEFT JOIN e2 b USING (trace_id) JOIN pk USING (trace_id))
SELECT trace_id, CASE WHEN len(left_) = 1 THEN left_[1] WHEN n2 IS NOT NULL THEN steps[lo2 + 1] WHEN list_contains(left_, pick) THEN pick ELSE left_[{'len(left_) // 2 + 1' if floor else '1'}] END AS root_step, steps[coalesce(lo2, lo) + 1] AS low, steps[coalesce(hi2, hi) + 1] AS high, coalesce(n2, n) AS probes,
CASE WHEN len(left_) = 1 THEN 'single' WHEN n2 IS NOT NULL THEN 'refined' WHEN list_contains(left_, pick) THEN 'picked' ELSE 'fallback' END AS how FROM w"""


_R = W.replace("WITH ", "WITH RECURSIVE ", 1)
query("blame_narrowed", _R + f", {_bisected(3, True, 64)}")(_narrowed(True))
query("blame_cascade", _R + f", {_bisected(6, False, 8)}")(_narrowed(False))

# --- drift

query("detect_topic_drift", "WITH e AS (SELECT label AS trace_id, vec_id AS event_id, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS back FROM embeddings WHERE vec_id % 3 < 2), g AS (SELECT label AS trace_id, arg_min(embedding::DOUBLE[], vec_id) AS goal FROM embeddings GROUP BY 1) SELECT trace_id, event_id, round(list_cosine_similarity(v, goal), 6) AS similarity FROM e JOIN g USING (trace_id) WHERE back <= 60 AND list_cosine_similarity(v, goal) < 0.05")(
    lambda s, d: (lambda e: assembly.topic_drift(e.select(C("label").alias("trace_id"), C("vec_id").alias("event_id"), C("vec_id").alias("pos"), F.element_at(F.array(L("plan"), L("observation"), L("tool.call")), (C("vec_id") % 3 + 1).cast("int")).alias("event_type"), C("embedding").alias("vector")), e.groupBy(C("label").alias("trace_id")).agg(F.min_by("embedding", "vec_id").alias("goal_vector")), cosine(C("vector"), C("goal_vector")), threshold=0.05).select("trace_id", "event_id", F.round("similarity", 6).alias("similarity")))(table(s, d, "embeddings"))
)

# --- answers that break off: ten items of eight characters, cut somewhere after the first

_CUT = "18 + (conv_id * 7 + turn) % 74"
query("text_lenient_json", f"SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN NULL ELSE least(10, (({_CUT}) - 10) // 8) END AS items FROM conversations")(
    lambda s, d: table(s, d, "conversations").select("conv_id", "turn", F.expr(_CUT).cast("int").alias("cut"), F.concat(L('{"events":['), F.array_join(F.transform(F.sequence(L(0), L(9)), lambda i: F.concat(L('{"k":'), i.cast("string"), L("}"))), ","), L("]}")).alias("j")).select("conv_id", "turn", F.size(F.try_variant_get(repair.lenient_object(F.concat(F.when(C("turn") % 4 == 1, L("```json\n")).when(C("turn") % 4 == 2, L("Here: ")).when(C("turn") % 4 == 3, L("no braces ")).otherwise(""), F.when(C("turn") % 4 < 3, F.substring(C("j"), L(1), C("cut"))).otherwise("at all"))), "$.events", "array<variant>")).cast("long").alias("items"))
    .select("conv_id", "turn", F.when(C("items") >= 0, C("items")).alias("items"))
)

# --- a folder of six kinds of files


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumns({"kind": C("conv_id") % 6, "file": F.concat(L("in/c"), C("conv_id").cast("string"), F.when((C("conv_id") % 6).isin(1, 3, 5), L(".json")).otherwise(L(".jsonl")))})
    line = F.when(C("kind") == 0, F.to_json(F.struct(F.concat(L("s"), C("turn").cast("string")).alias("span_id"), L("generation").alias("name"), C("role").alias("agent"), C("text").alias("result")))).when(C("kind") == 2, F.to_json(F.struct(C("role"), C("text").alias("content")))).when(C("turn") == 1, L('{"broken')).otherwise(L('{"role":"user"}'))
    lines = rows.where("kind in (0, 2, 4)").select("file", C("turn").alias("line"), line.alias("value"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(L("message").alias("type"), t["role"].alias("role"), t["text"].alias("content")))
    whole = rows.where("kind in (1, 3, 5)").groupBy("file", "kind").agg(F.to_json(items).alias("items"))
    value = F.when(C("kind") == 1, F.concat(L('{"events":'), "items", L("}"))).when(C("kind") == 3, F.concat(L('{"task_id":"'), F.regexp_extract("file", "c([0-9]+)", 1), L('","messages":'), "items", L("}"))).otherwise('{"nothing":"known"}')
    return lines.unionByName(whole.select("file", L(0).cast("long").alias("line"), value.alias("value")))


_KIND = "conv_id % 6"
_FOLDER = f"""f AS (SELECT conv_id, turn, role, text, {_KIND} AS kind, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n, max(turn = 1) OVER (PARTITION BY conv_id) AS bad FROM conversations)"""
_MSG = "CASE WHEN lower(role) IN ('user', 'human') THEN 'observation' WHEN lower(role) = 'system' THEN 'run.start' WHEN lower(role) IN ('tool', 'function') THEN 'tool.result' ELSE 'agent.step' END"
_ALONE = "(kind = 2 AND n = 1) OR (kind = 0 AND n = 1)"
query("ingest_folder_files", f"WITH {_FOLDER} SELECT concat('in/c', conv_id, CASE WHEN kind IN (1, 3, 5) THEN '.json' ELSE '.jsonl' END) AS file, CASE WHEN {_ALONE} THEN NULL WHEN kind = 0 THEN 'spans' WHEN kind = 1 THEN 'event_list' WHEN kind = 2 THEN 'message_list' WHEN kind = 3 THEN 'messages' WHEN kind = 4 AND NOT bad AND n > 1 THEN 'message_list' END AS format, CASE WHEN {_ALONE} OR kind = 5 OR (kind = 4 AND NOT bad AND n = 1) THEN 'no known format' WHEN kind = 4 AND bad THEN 'line 1 is not JSON' END AS error FROM f GROUP BY ALL")(
    lambda s, d: folders.convert(_files(s, d))[1]
)
query("ingest_folder_events", f"""WITH {_FOLDER} SELECT CASE WHEN kind = 3 THEN conv_id::VARCHAR ELSE concat('c', conv_id) END AS trace_id, cast(i AS int) AS pos, CASE WHEN kind = 0 THEN 'llm.call' WHEN kind = 1 THEN 'agent.step' ELSE {_MSG} END AS event_type, CASE WHEN kind IN (2, 3) THEN lower(role) WHEN kind = 4 THEN 'user' ELSE role END AS agent_name, text AS output, CASE kind WHEN 0 THEN 'spans' WHEN 1 THEN 'event_list' WHEN 2 THEN 'message_list' ELSE 'messages' END AS format FROM f WHERE kind IN (1, 3) OR (kind IN (0, 2) AND n > 1)""")(
    lambda s, d: folders.convert(_files(s, d))[0].where("output is not null and output <> ''").select("trace_id", C("pos").cast("int").alias("pos"), "event_type", "agent_name", "output", "format")
)

# --- clusters by running centroids: the plain walk, row by row, carries all centroids along

query(
    "taxonomy_vector_clusters",
    """WITH RECURSIVE v AS (SELECT label, vec_id, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings),
w(label, i, ids, ns, cs, id, leader) AS (
SELECT DISTINCT label, 0::BIGINT, []::BIGINT[], []::BIGINT[], []::DOUBLE[][], NULL::BIGINT, NULL::BIGINT FROM v
UNION ALL SELECT label, i, CASE WHEN k IS NULL THEN list_append(ids, vec_id) ELSE ids END, CASE WHEN k IS NULL THEN list_append(ns, 1) ELSE list_transform(ns, lambda n, j: CASE WHEN j = k THEN n + 1 ELSE n END) END,
CASE WHEN k IS NULL THEN list_append(cs, e) ELSE list_transform(cs, lambda c, j: CASE WHEN j = k THEN list_transform(list_zip(c, e), lambda z: (z[1] * ns[k] + z[2]) / (ns[k] + 1)) ELSE c END) END, vec_id, coalesce(ids[k], vec_id)
FROM (SELECT *, CASE WHEN list_max(sims) >= 0.15 THEN list_position(sims, list_max(sims)) END AS k FROM (SELECT w.label, v.i, ids, ns, cs, vec_id, e, list_transform(cs, lambda c: list_cosine_similarity(c, e)) AS sims FROM w JOIN v ON v.label = w.label AND v.i = w.i + 1)))
SELECT label AS bucket, 0::BIGINT AS block, id, leader FROM w WHERE id IS NOT NULL""",
)(lambda s, d: leaders.leader_clusters(table(s, d, "embeddings"), "label", "vec_id", id_col="vec_id", vector_col="embedding", threshold=0.15))

# --- records by equality, and analyses of several trials

query("lessons_matching", "SELECT event_id, event_type, user_id % 5 AS app FROM events WHERE event_type = 'click' AND user_id % 5 = 2")(lambda s, d: lessons.matching(table(s, d, "events").select("event_id", "event_type", (C("user_id") % 5).alias("app")), event_type="click", app=2))
query("screen_debugger_refs", "SELECT concat('trial', turn) AS trial, conv_id AS task_id, CASE WHEN turn % 2 = 0 THEN role ELSE concat('trial', turn) END AS model, CASE WHEN turn % 4 <> 2 THEN cast(length(text) AS int) END AS root_error_step, 'E1' AS taxonomy_tag, text AS evidence, '' AS correction FROM conversations WHERE turn % 5 < 3")(
    lambda s, d: screens.debugger_refs(table(s, d, "conversations").select(F.concat(L("trial"), C("turn").cast("string")).alias("trial"), C("conv_id").alias("task_id"), F.when(C("turn") % 5 == 3, L("[1]")).when(C("turn") % 5 == 4, L('{"cut')).otherwise(F.to_json(F.struct(F.when(C("turn") % 2 == 0, C("role")).otherwise(L("")).alias("model"), F.when(C("turn") % 4 != 2, F.char_length("text")).alias("root_error_step"), L("E1").alias("taxonomy_tag"), C("text").alias("evidence")))).alias("value")))
)

# --- clusters by words: labels first, then the plain walk over the rest

_WORDS = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))"
query(
    "taxonomy_lexical_clusters",
    f"""WITH RECURSIVE o AS MATERIALIZED (SELECT (conv_id % 7)::INT AS bucket, conv_id * 1000 + turn AS id, CASE WHEN turn % 3 = 0 AND conv_id % 2 = 0 THEN role END AS label, {_WORDS} AS x FROM conversations),
lab AS (SELECT bucket, label, min(id) AS seen, list_distinct(flatten(list(x))) AS x FROM o WHERE label IS NOT NULL GROUP BY ALL),
v AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY id) AS i FROM o WHERE label IS NULL),
w(bucket, i, names, xs, id, cluster) AS (
SELECT b.bucket, 0::BIGINT, coalesce(l.names, []::VARCHAR[]), coalesce(l.xs, []::VARCHAR[][]), NULL::BIGINT, NULL::VARCHAR FROM (SELECT DISTINCT bucket FROM v) b LEFT JOIN (SELECT bucket, list(label ORDER BY seen) AS names, list(x ORDER BY seen) AS xs FROM lab GROUP BY 1) l USING (bucket)
UNION ALL SELECT bucket, i, CASE WHEN k IS NULL THEN list_append(names, id::VARCHAR) ELSE names END, CASE WHEN k IS NULL THEN list_append(xs, x) ELSE list_transform(xs, lambda y, j: CASE WHEN j = k THEN list_distinct(list_concat(y, x)) ELSE y END) END, id, coalesce(names[k], id::VARCHAR)
FROM (SELECT *, CASE WHEN list_max(s) >= 0.28 THEN list_position(s, list_max(s)) END AS k FROM (SELECT w.bucket, v.i, names, xs, v.id, x, list_transform(xs, lambda y: coalesce(len(list_intersect(y, x))::DOUBLE / nullif(len(y) + len(x) - len(list_intersect(y, x)), 0), 0)) AS s FROM w JOIN v ON v.bucket = w.bucket AND v.i = w.i + 1)))
SELECT bucket, 0::BIGINT AS block, id::VARCHAR AS id, cluster FROM w WHERE id IS NOT NULL UNION ALL SELECT bucket, 0, id::VARCHAR, label FROM o WHERE label IS NOT NULL""",
)(
    lambda s, d: leaders.lexical_clusters(table(s, d, "conversations").select((C("conv_id") % 7).cast("int").alias("bucket"), (C("conv_id") * 1000 + C("turn")).alias("ord"), (C("conv_id") * 1000 + C("turn")).alias("id"), F.when((C("turn") % 3 == 0) & (C("conv_id") % 2 == 0), C("role")).alias("label"), F.array_distinct(F.regexp_extract_all(F.lower("text"), L("[a-z0-9]+"), L(0))).alias("tokens")))
)
