"""Queries of labels, taxonomy and lessons, with their oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import trace as X
from ..operators import evaluate, judgement, lessons, memory
from ..sources.fixtures import RICH_SQL, table
from .events import FOUND, findings, rich
from .registry import query

C, L = F.col, F.lit


def _pick(column: Column, n: int, *values) -> Column:
    return F.element_at(F.array(*[L(v) for v in values]), (column % n + 1).cast("int"))


def _case(column: str, n: int, *values: str) -> str:
    return f"CASE {column} % {n} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


# --- labels: tasks are labelled documents, tags made from their ids

_TAGS = ("G1", "G2", "IF2", " infeasible task ", "", "P3")
_HUMAN_SQL = f"""h AS (SELECT doc_id AS task_id, {_case('doc_id', 6, "'G1'", "'G2'", "'IF2'", "'IF'", "''", "'P3'")} AS tag1, CASE WHEN doc_id % 7 > 0 THEN cast(doc_id % 5 AS int) END AS step1, {_case('doc_id', 4, "'G1'", "'P3'", "'IF'", "'G2'")} AS tag2, CASE WHEN doc_id % 3 = 0 THEN 'P3' WHEN doc_id % 3 = 1 THEN '' END AS ftag FROM labels)"""


def _humans(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = C("doc_id")
    label = lambda tag, step, who: F.struct(tag.alias("tag"), step.cast("int").alias("step"), L(who).alias("annotator"))
    one = label(_pick(d, 6, *_TAGS), F.when(d % 7 > 0, d % 5), "ann")
    two = label(_pick(d, 4, "G1", "P3", "Infeasible Task", "G2"), L(3), "bo")
    final = F.when(d % 3 < 2, label(F.when(d % 3 == 0, "P3").otherwise(""), L(1), "final"))
    return table(spark, sf_dir, "labels").select(d.alias("task_id"), final.alias("final"), F.when(d % 5 == 0, F.array(one)).otherwise(F.array(one, two)).alias("humans"))


_ONE_OK, _TWO = "(tag1 <> '' AND step1 IS NOT NULL)", "task_id % 5 > 0"
_CHOSEN = {
    "final_decision": "SELECT task_id, 'P3' AS h_tag, 1 AS h_step, 'final' AS annotator FROM h WHERE ftag = 'P3'",
    "final_or_single": f"SELECT task_id, CASE WHEN ftag = 'P3' THEN 'P3' WHEN {_ONE_OK} THEN tag1 ELSE tag2 END AS h_tag, CASE WHEN ftag = 'P3' THEN 1 WHEN {_ONE_OK} THEN step1 ELSE 3 END AS h_step, CASE WHEN ftag = 'P3' THEN 'final' WHEN {_ONE_OK} THEN 'ann' ELSE 'bo' END AS annotator FROM h WHERE coalesce(ftag = 'P3', false) OR ({_ONE_OK})::int + ({_TWO})::int = 1",
    "first_human": f"SELECT task_id, CASE WHEN {_ONE_OK} THEN tag1 ELSE tag2 END AS h_tag, CASE WHEN {_ONE_OK} THEN step1 ELSE 3 END AS h_step, CASE WHEN {_ONE_OK} THEN 'ann' ELSE 'bo' END AS annotator FROM h WHERE {_ONE_OK} OR {_TWO}",
}
for _policy, _sql in _CHOSEN.items():
    query(f"labels_{_policy}", f"WITH {_HUMAN_SQL} {_sql}")(lambda s, d, p=_policy: judgement.select_human(_humans(s, d), p))

HUMAN = f"WITH {_HUMAN_SQL}, hum AS ({_CHOSEN['first_human']}), rca AS (SELECT doc_id AS task_id, {_case('doc_id', 5, *[repr(f'E{i}') for i in range(5)])} AS tag, cast(doc_id % 4 AS int) AS step, (doc_id % 9) / 10.0::DOUBLE AS confidence FROM documents), map AS (SELECT * FROM (VALUES ('E0', 'G1'), ('E1', 'G2'), ('E2', 'NONE'), ('E3', 'P3'), ('E4', 'P9')) m(tag, target)) "


def _rca(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = C("doc_id")
    return table(spark, sf_dir, "documents").select(d.alias("task_id"), _pick(d, 5, *[f"E{i}" for i in range(5)]).alias("tag"), (d % 4).cast("int").alias("step"), ((d % 9) / 10).alias("confidence"))


def _mapping(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("E0", "G1"), ("E1", "G2"), ("E2", "NONE"), ("E3", "P3"), ("E4", "P9")], "tag string, target string")


def _human(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judgement.select_human(_humans(spark, sf_dir), "first_human")


def _projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judgement.project(_rca(spark, sf_dir), _mapping(spark), _human(spark, sf_dir))


PROJECTED = HUMAN + ", prj AS (SELECT r.task_id, m.target AS l_tag, r.step AS l_step, h_tag, h_step FROM rca r JOIN map m USING (tag) JOIN hum USING (task_id) WHERE m.target <> 'NONE') "
query("labels_paired", HUMAN + "SELECT r.task_id, tag, step, confidence, h_tag, h_step, annotator FROM rca r JOIN hum USING (task_id)")(lambda s, d: judgement.load_pairs(_rca(s, d), _human(s, d)))
query("labels_pair_counts", HUMAN + "SELECT count(h.task_id) AS common, count(*) - count(h.task_id) AS skipped FROM rca LEFT JOIN hum h USING (task_id)")(lambda s, d: judgement.pair_counts(_rca(s, d), _human(s, d)))
query("labels_projected", PROJECTED + "SELECT * FROM prj")(_projected)
query("labels_coverage_purity", HUMAN + "SELECT round((SELECT count(*) FILTER (x IN (SELECT target FROM map WHERE target <> 'NONE')) / count(*)::DOUBLE FROM (SELECT DISTINCT h_tag AS x FROM rca JOIN hum USING (task_id))), 4) AS coverage, round((SELECT count(*) FILTER (target <> 'NONE') / count(*)::DOUBLE FROM map), 4) AS purity")(lambda s, d: judgement.coverage_purity(_rca(s, d), _mapping(s), _human(s, d)))
_CAT = ", c AS (SELECT task_id, regexp_extract(h_tag, '^[A-Z]+') AS h_tag, regexp_extract(l_tag, '^[A-Z]+') AS l_tag, h_step, l_step FROM prj) "
query("labels_category_scores", PROJECTED + _CAT + ", r AS (SELECT h_tag AS tag, 1 AS h, 0 AS l, (h_tag = l_tag)::int AS ok FROM c UNION ALL SELECT l_tag, 0, 1, 0 FROM c), g AS (SELECT tag, sum(h)::BIGINT AS support, sum(l)::BIGINT AS predicted, sum(ok)::BIGINT AS correct FROM r GROUP BY 1), q AS (SELECT *, coalesce(correct::DOUBLE / nullif(predicted, 0), 0) AS p, coalesce(correct::DOUBLE / nullif(support, 0), 0) AS rc FROM g) SELECT tag, support, round(p, 4) AS precision, round(rc, 4) AS recall, round(coalesce(2 * p * rc / nullif(p + rc, 0), 0), 4) AS f1 FROM q")(lambda s, d: evaluate.precision_recall(judgement.by_category(_projected(s, d))))
query("labels_category_headline", PROJECTED + _CAT + "SELECT count(*) AS n, round(avg((h_tag = l_tag)::int), 4) AS category_exact FROM c")(lambda s, d: evaluate.headline(judgement.by_category(_projected(s, d))).select("n", C("tag_exact").alias("category_exact")))
query("labels_step_bias", PROJECTED + "SELECT round(avg(abs(l_step - h_step)), 4) AS mae, round(avg(l_step - h_step), 4) AS mean_error, count(*) FILTER (l_step < h_step) AS early, count(*) FILTER (l_step = h_step) AS exact, count(*) FILTER (l_step > h_step) AS late, CASE WHEN avg(l_step - h_step) < 0 THEN 'early' WHEN avg(l_step - h_step) > 0 THEN 'late' ELSE 'neutral' END AS bias FROM prj")(lambda s, d: judgement.step_bias(_projected(s, d)))
query("labels_full_accuracy", PROJECTED + "SELECT count(*) AS n, round(avg((h_tag = l_tag)::int), 4) AS tag_exact, round(avg((h_step = l_step)::int), 4) AS step_exact, (SELECT count(*) FROM rca LEFT JOIN hum h USING (task_id) WHERE h.task_id IS NULL) AS skipped FROM prj")(lambda s, d: evaluate.headline(_projected(s, d)).select("n", "tag_exact", "step_exact").crossJoin(judgement.pair_counts(_rca(s, d), _human(s, d)).select("skipped")))
query("labels_examples", HUMAN + "SELECT tag, task_id, cast(rank AS int) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY confidence DESC, task_id) AS rank FROM rca) WHERE rank <= 3")(lambda s, d: judgement.examples(_rca(s, d)))
query("labels_case_set", HUMAN + "SELECT task_id FROM rca WHERE task_id IN (SELECT task_id FROM hum)")(lambda s, d: _rca(s, d).join(_human(s, d), "task_id", "left_semi").select("task_id"))
query("labels_seeded_order", HUMAN + "SELECT task_id, md5(concat('7:', task_id)) AS order_key FROM rca")(lambda s, d: judgement.seeded_order(_rca(s, d).select("task_id"), "task_id", 7))

# --- taxonomy

SEEDS = ["planning.inefficient_plan", "system.environment_error", "action.format_error"]
OBS = f"WITH {RICH_SQL}, {FOUND}, obs AS (SELECT trace_id, finding_id, mode_id, split_part(mode_id, '.', 1) AS family, CASE WHEN mode_id NOT IN ({', '.join(map(repr, SEEDS))}) THEN 'unknown_mode' ELSE 'low_confidence' END AS source, ordinal, concat('the ', replace(mode_id, '.', ' '), ' of ', agent_name) AS text FROM fnd WHERE mode_id NOT IN ({', '.join(map(repr, SEEDS))}) OR confidence < 0.4) "


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = findings(rich(spark, sf_dir)).withColumn("text", F.concat(L("the "), F.replace("mode_id", L("."), L(" ")), L(" of "), "agent_name"))
    return judgement.observations(rows, SEEDS)


_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)
_SLUG = f"array_to_string(list_filter(regexp_extract_all(lower(mode_id), '[a-z0-9]+'), lambda x: length(x) > 2 AND x NOT IN ({_STOP}))[1:4], '_')"
query("taxonomy_observations", OBS + "SELECT * FROM obs")(_observed)
query("taxonomy_clusters", OBS + f", c AS (SELECT *, {_SLUG} AS cluster FROM obs), v AS (SELECT cluster, family, count(*) AS n, min(struct_pack(a := trace_id, b := ordinal)) AS seen FROM c GROUP BY ALL) SELECT cluster, count(*) AS support, (SELECT arg_min(family, struct_pack(a := -n, b := seen)) FROM v WHERE v.cluster = c.cluster) AS family FROM c GROUP BY 1")(lambda s, d: judgement.label_clusters(_observed(s, d)))
query("taxonomy_cluster_order", OBS + f", c AS (SELECT {_SLUG} AS cluster, count(*) AS support, min(family) AS family FROM obs GROUP BY 1) SELECT * FROM c WHERE support >= 2 ORDER BY support DESC, cluster LIMIT 12")(lambda s, d: judgement.cluster_order(judgement.label_clusters(_observed(s, d))))
query("taxonomy_cluster_terms", OBS + f", t AS (SELECT {_SLUG} AS cluster, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 2 AND x NOT IN ({_STOP})))) AS term FROM obs) SELECT cluster, term, n, cast(rank AS int) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, term) AS rank FROM (SELECT cluster, term, count(*) AS n FROM t GROUP BY ALL)) WHERE rank <= 5")(lambda s, d: judgement.cluster_terms(_observed(s, d)))
_SEED_ROWS = [("s1", "planning", "plan repeats without progress"), ("s2", "system", "the environment raised an error"), ("s3", "memory", "loss of context")]
query(
    "taxonomy_nearest_seed",
    f"WITH sd AS (SELECT * FROM (VALUES {', '.join(map(str, _SEED_ROWS))}) v(seed, family, text)), w AS (SELECT *, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), lambda x: length(x) > 2 AND x NOT IN ({_STOP})) AS x FROM sd), p AS (SELECT conv_id * 1000 + turn AS proposal, {_case('turn', 3, repr('planning'), repr('system'), repr('x'))} AS family, list_filter(list_distinct(regexp_extract_all(lower(concat(text, ' plan progress')), '[a-z0-9]+')), lambda x: length(x) > 2 AND x NOT IN ({_STOP})) AS y FROM conversations), j AS (SELECT proposal, seed, coalesce(len(list_intersect(x, y))::DOUBLE / nullif(len(list_distinct(list_concat(x, y))), 0), 0) + CASE WHEN p.family = w.family THEN 0.05 ELSE 0 END AS s FROM p, w) SELECT proposal, arg_max(seed, struct_pack(a := s, b := seed)) AS seed, round(max(s), 6) AS similarity, max(s) >= 0.6 AS duplicate FROM j GROUP BY 1",
)(
    lambda s, d: judgement.nearest_seed(
        table(s, d, "conversations").select((C("conv_id") * 1000 + C("turn")).alias("proposal"), _pick(C("turn"), 3, "planning", "system", "x").alias("family"), X.tokens(F.concat("text", L(" plan progress"))).alias("words")),
        s.createDataFrame(_SEED_ROWS, "seed string, seed_family string, text string").select("seed", "seed_family", X.tokens(C("text")).alias("seed_words")),
    )
)


def _operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four operations for each user: two appends, a split of the first, then by id a merge, a rename, or a reuse of what isn't there."""
    runs = table(spark, sf_dir, "events").select(C("user_id").alias("run")).distinct()
    none = F.array().cast("array<string>")
    op = lambda i, op, code, args=none: F.struct(L(i).alias("ord"), (L(op) if isinstance(op, str) else op).alias("op"), (L(code) if isinstance(code, str) else code).alias("code"), args.alias("args"))
    k = C("run") % 3
    last = op(3, F.when(k == 0, "merge").when(k == 1, "rename").otherwise("reuse"), F.when(k == 0, "M").when(k == 1, "B").otherwise("A"), F.when(k == 0, F.array(L("A1"), L("B"))).otherwise(none))
    return runs.select("run", F.explode(F.array(op(0, "append", "A"), op(1, "append", "B"), op(2, "split", "A", F.array(L("A1"), L("A2"))), last)).alias("o")).select("run", "o.*")


query("taxonomy_fold", "SELECT user_id AS run, CASE user_id % 3 WHEN 0 THEN 'A2,M' WHEN 1 THEN 'A1,A2,B' END AS codes FROM (SELECT DISTINCT user_id FROM events)")(lambda s, d: judgement.fold_taxonomy(_operations(s, d)).select("run", F.when(C("codes").isNotNull(), F.array_join("codes", ",")).alias("codes")))

# --- lessons: one per vector

_LESSON_SQL = "les AS (SELECT vec_id AS id, label AS tag, cast(vec_id % 3 AS int) AS app, cast(vec_id % 50 AS int) AS created, 0.4 * exp(-(60 - vec_id % 50) / 30.0::DOUBLE) + 0.4 * ln(1 + vec_id % 4) + 0.2 * (1 + 0.25 * (vec_id % 3)) AS score FROM embeddings)"


def _lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = C("vec_id")
    rows = table(spark, sf_dir, "embeddings").select(i.alias("id"), C("label").alias("tag"), (i % 3).cast("int").alias("app"), (i % 50).cast("int").alias("created"), C("embedding").alias("vector"))
    return rows.select("*", F.slice(F.transform(F.sequence(L(0), L(4)), lambda x: C("id") * 10 + x), 1, (C("id") % 4).cast("int")).alias("refs"), lessons.composite_score(L(60) - C("created"), C("id") % 4, C("id") % 3).alias("score"))


query("lessons_score", f"WITH {_LESSON_SQL} SELECT id, round(score, 9) AS score FROM les")(lambda s, d: _lessons(s, d).select("id", F.round("score", 9).alias("score")))
query("lessons_pick", f"WITH {_LESSON_SQL}, ask AS (SELECT DISTINCT tag, a.x AS app FROM les, (VALUES (0), (2), (7)) a(x)) SELECT tag, app, coalesce((SELECT arg_max(id, struct_pack(a := score, b := created, c := id)) FROM les WHERE les.tag = ask.tag AND les.app = ask.app), (SELECT arg_max(id, struct_pack(a := score, b := created, c := id)) FROM les WHERE les.tag = ask.tag)) AS id FROM ask")(
    lambda s, d: (lambda les: lessons.pick(les, les.select("tag").distinct().select("tag", F.explode(F.array(L(0), L(2), L(7))).alias("app"))))(_lessons(s, d))
)
query("lessons_ranked", f"WITH {_LESSON_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY score DESC, created DESC, id) AS r, count(*) OVER (PARTITION BY tag) AS n FROM les WHERE id % 7 > 0) SELECT tag, id, cast(r AS int) AS rank, concat(least(3, n), ' of ', n) AS coverage FROM x WHERE r <= 3")(lambda s, d: (lambda les: lessons.ranked(les, les.where("id % 7 = 0").select("id"), "tag", 3))(_lessons(s, d)))
query("lessons_retrieve", "WITH v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings) SELECT query, id, round(score, 6) AS score, cast(r AS int) AS rank FROM (SELECT q.id AS query, v.id, list_cosine_similarity(q.e, v.e) AS score, row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(q.e, v.e) DESC, v.id) AS r FROM v q JOIN v ON q.label = v.label AND q.id <> v.id WHERE q.id % 50 = 0 AND list_cosine_similarity(q.e, v.e) >= 0.2) WHERE r <= 3")(
    lambda s, d: (lambda v: lessons.retrieve(v.where("id % 50 = 0"), v, 3, 0.2).withColumn("score", F.round("score", 6)))(table(s, d, "embeddings").select(C("vec_id").alias("id"), C("label").alias("bucket"), C("embedding").alias("vector")))
)
_ACT = "concat('act', repeat('x', cast(vec_id % 3 AS int)))"
query("lessons_merged", f"WITH l AS (SELECT vec_id AS id, label AS tag, vec_id % 2 AS app, vec_id % 50 AS created, {_ACT} AS act FROM embeddings), f AS (SELECT tag, app, act, count(*) AS n FROM l GROUP BY ALL) SELECT tag, cast(app AS int) AS app, count(*) AS n, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT (id % 5)::int AS x FROM l m WHERE m.tag = l.tag AND m.app = l.app)) AS refs, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT (id % 4)::int AS x FROM l m WHERE m.tag = l.tag AND m.app = l.app) WHERE x <> l.tag) AS confusions, arg_max(concat('fix', id), struct_pack(a := created, b := id)) AS corrected_action, (SELECT arg_min(act, struct_pack(a := -n, b := length(act), c := act)) FROM f WHERE f.tag = l.tag AND f.app = l.app) AS failed_action FROM l GROUP BY tag, app")(
    lambda s, d: (
        lambda i: lessons.merged(
            table(s, d, "embeddings").select(i.alias("id"), C("label").alias("tag"), (i % 2).cast("int").alias("app"), (i % 50).alias("created"), F.array((i % 5).cast("int")).alias("refs"), F.array((i % 4).cast("int")).alias("confusions"), F.concat(L("act"), F.repeat(L("x"), (i % 3).cast("int"))).alias("failed_action"), F.concat(L("fix"), i.cast("string")).alias("corrected_action")),
            "tag", "app",
        ).select("tag", "app", "n", F.array_join(C("refs").cast("array<string>"), ",").alias("refs"), F.nullif(F.array_join(C("confusions").cast("array<string>"), ","), L("")).alias("confusions"), "corrected_action", "failed_action")
    )(C("vec_id"))
)
query("lessons_episode_lookup", "SELECT vec_id AS id, ref, e.title FROM (SELECT vec_id, unnest(range(vec_id * 10, vec_id * 10 + vec_id % 4)) AS ref FROM embeddings) LEFT JOIN (SELECT event_id AS ref2, event_type AS title FROM events) e ON e.ref2 = ref")(lambda s, d: lessons.episode_lookup(_lessons(s, d).select("id", "refs"), table(s, d, "events").select(C("event_id").alias("episode_id"), C("event_type").alias("title"))).select("id", "ref", "title"))
_MERGE = "WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w, list_transform(['a', 'e', 'i', 'o', 'u'], lambda c: (length(text) - length(replace(text, c, '')))::DOUBLE) AS v FROM conversations), n AS (SELECT a.conv_id, a.turn, coalesce(list_cosine_similarity(a.v, b.v), 0) AS c, len(list_intersect(a.w, b.w))::DOUBLE / nullif(len(list_distinct(list_concat(a.w, b.w))), 0) AS j, len(list_filter(a.w, lambda z: NOT list_contains(b.w, z))) AS gain FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn <> b.turn), g AS (SELECT conv_id, turn, count(*) AS n, max(gain) AS gain FROM n WHERE j >= 0.1 AND c >= 0.97 AND NOT isnan(c) GROUP BY ALL) SELECT conv_id * 1000 + turn AS id, CASE WHEN n IS NULL THEN 'ADD' WHEN n > 1 THEN 'MERGE' WHEN gain < 3 THEN 'NOOP' ELSE 'UPDATE' END AS action FROM t LEFT JOIN g USING (conv_id, turn)"


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a turn's vector: how often it has each vowel
    vowels = F.transform(F.array(*map(L, "aeiou")), lambda c: (F.char_length("text") - F.char_length(F.replace(C("text"), c, L("")))).cast("double"))
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", (C("conv_id") * 1000 + C("turn")).alias("id"), T.word_set(C("text")).alias("w"), vowels.alias("v"))
    pairs = t.join(t.select("conv_id", C("turn").alias("other"), C("w").alias("y"), C("v").alias("u")), "conv_id").where("turn <> other")
    near = pairs.select("id", T.jaccard(C("w"), C("y")).alias("jaccard"), T.cosine(C("v"), C("u")).alias("cosine"), F.size(F.array_except("w", "y")).alias("gain"))
    return memory.route(lessons.strong_matches(near, 0.97, 0.1), t, "gain")


query("lessons_route", _MERGE)(_routed)
query("lessons_search_memory", "WITH t AS (SELECT conv_id * 1000 + turn AS id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM conversations), m AS (SELECT * FROM t ORDER BY id DESC LIMIT 200), s AS (SELECT q.id AS query, m.id, coalesce(len(list_intersect(q.w, m.w))::DOUBLE / nullif(len(list_distinct(list_concat(q.w, m.w))), 0), 0) AS score FROM t q, m WHERE q.id % 50 = 0 AND q.id <> m.id) SELECT query, id, round(score, 9) AS score, cast(r AS int) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS r FROM s WHERE score > 0) WHERE r <= 3")(
    lambda s, d: (lambda t: lessons.search_memory(t.where("id % 50 = 0"), t, 3).withColumn("score", F.round("score", 9)))(table(s, d, "conversations").select((C("conv_id") * 1000 + C("turn")).alias("id"), (C("conv_id") * 1000 + C("turn")).alias("created"), T.word_set(C("text")).alias("words")))
)


def _soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = C("vec_id")
    return lessons.soft_tags(table(spark, sf_dir, "embeddings").select(i.alias("step_id"), _pick(i, 5, "click", " Drag", "type", "scroll", "key").alias("action"), _pick(i, 4, "firefox", "GIMP", "terminal", "other").alias("app"), F.when(i % 4 < 3, (i % 7) / 10).alias("delta")))


_P, _G, _R, _S = (
    "1 + CASE vec_id % 5 WHEN 0 THEN 1.5 WHEN 1 THEN 0.5 ELSE 0 END + CASE vec_id % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 1.5 ELSE 0 END",
    "1 + CASE vec_id % 5 WHEN 0 THEN 2.5 WHEN 1 THEN 3.0 ELSE 0 END + CASE vec_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 ELSE 0 END + CASE WHEN d >= 0.4 THEN 0.5 WHEN d > 0.02 THEN 0.3 ELSE 0 END",
    "1 + CASE vec_id % 5 WHEN 2 THEN 2.5 WHEN 4 THEN 2.0 ELSE 0 END + CASE vec_id % 4 WHEN 2 THEN 1.5 ELSE 0 END + CASE WHEN d <= 0.02 THEN 2.5 ELSE 0 END",
    "1 + CASE WHEN d >= 0.4 THEN 2.0 ELSE 0 END",
)
query("lessons_soft_tags", f"WITH e AS (SELECT vec_id, CASE WHEN vec_id % 4 < 3 THEN (vec_id % 7) / 10.0::DOUBLE END AS d FROM embeddings), w AS (SELECT vec_id, [{_P}, {_G}, {_R}, {_S}]::DOUBLE[] AS x FROM e), t AS (SELECT vec_id AS step_id, unnest({list(lessons.CATEGORIES)}) AS category, unnest(x) / list_sum(x) AS p, unnest([0, 1, 2, 3]) AS place FROM w) SELECT step_id, category, round(p, 9) AS p, cast(row_number() OVER (PARTITION BY step_id ORDER BY p DESC, place) AS int) AS rank FROM t")(_soft)
