"""DuckDB SQL for the opN_ queries that SQL can express on whole tables."""

from __future__ import annotations

from . import license_scan

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Least id reachable over links(a, b), which holds both directions.
_REACH = """reach(id, root) AS (SELECT id, id FROM nodes UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id WHERE r.root < l.b),
comp AS (SELECT id, min(root) AS component_id FROM reach GROUP BY 1)"""

_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BASE32 = (
    "array_to_string(list_transform(range(8), lambda i: concat("
    + ", ".join(f"substr('{_B32}', ((('0x' || substr(sha, i::int * 5 + 1, 5))::int >> {s}) & 31) + 1, 1)" for s in (15, 10, 5, 0))
    + ")), '')"
)


def _licenses() -> str:
    """Every window of every text against every template, without an index."""
    t = license_scan
    words = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    templates = ", ".join(f"({i}, '{label}', {words(sorted(set(t.words_of(text))))})" for i, (label, text) in enumerate(t.TEMPLATES))
    phrases = ", ".join(f"('{label}', {words(t.words_of(text))})" for text, label in t.PHRASES)
    return f"""WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM documents),
p(label, m) AS (VALUES {phrases}), t(template, label, m) AS (VALUES {templates}),
place AS (SELECT doc_id, label, k FROM (SELECT doc_id, w, label, m, unnest(range(0, len(w) - len(m) + 1)) AS k FROM d, p WHERE list_has_all(w, m)) WHERE w[k + 1:k + len(m)] = m),
base AS (SELECT doc_id, count(*) AS n_base, min(k) AS first_word, max(k) AS last_word, list_sort(list(DISTINCT label)) AS ls FROM place GROUP BY 1),
block AS (SELECT doc_id, list_distinct(w[k * {t.STEP} + 1:k * {t.STEP} + {t.BLOCK}]) AS b FROM (SELECT doc_id, w, unnest(range(0, greatest(0, ceil((len(w) - {t.BLOCK}) / {t.STEP}))::BIGINT + 1)) AS k FROM d)),
found AS (SELECT doc_id, label, len(list_intersect(b, m)) / len(m) AS c FROM block, t WHERE {t.THRESHOLD.denominator} * len(list_intersect(b, m)) >= {t.THRESHOLD.numerator} * len(m)),
more AS (SELECT doc_id, list(DISTINCT label) AS ls, max(c) AS c FROM found GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(base.ls, ','), '') AS base_labels,
coalesce(array_to_string(list_sort(list_distinct(list_concat(base.ls, more.ls))), ','), '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(c, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)"""


_WHOLE = "list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))"


def _clusters() -> str:
    """Three rounds of plain assignment and means."""
    apart = "list_sum(list_transform(list_zip(v.q, {c}.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    near = lambda r: f"a{r} AS MATERIALIZED (SELECT vec_id, v.q, k, {apart.format(c=f'c{r}')} AS d FROM v, c{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)"
    mean = lambda r: f"""s{r} AS (SELECT k, place, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x FROM (SELECT k, unnest(q) AS x, unnest(range(64)) AS place FROM a{r - 1}) GROUP BY 1, 2),
c{r} AS MATERIALIZED (SELECT k, coalesce(m.q, c.q) AS q FROM c{r - 1} c LEFT JOIN (SELECT k, list(x ORDER BY place) AS q FROM s{r} GROUP BY 1) m USING (k))"""  # noqa: E731
    steps = ",\n".join(x for r in range(1, 4) for x in (mean(r), near(r)))
    return f"""WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE len(embedding) = 64 AND {_WHOLE}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k, q FROM v ORDER BY sha256('1:' || vec_id) LIMIT 16),
{near(0)},
{steps}
SELECT vec_id, a3.k::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a3.k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c3.q, ',')) AS centroid_sha256 FROM a3 JOIN c3 USING (k)"""


ORACLES: dict[str, str] = {
    "op1_inverted_multi_index": f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.95),
nodes AS (SELECT vec_id AS id FROM v), {_REACH}
SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = id) AS n_links, component_id, id = component_id AS kept FROM comp""",
    "op3_warc_salvage": f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f""",
    "op5_winnowing_decontamination": f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, m, array_to_string(w[k:k + m - 1], ' ') AS s FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM (SELECT *, least(10, len(w)) AS m FROM i WHERE len(w) > 0))),
dw AS (SELECT doc_id, k, m, array_to_string(w[k:k + m - 1], ' ') AS s FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM win))),
h AS (SELECT doc_id, k, m, item_id FROM dw JOIN win USING (m, s)),
hits AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS place FROM h) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id::varchar, ',' ORDER BY item_id::varchar)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op9_substring_dedup": f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
win AS (SELECT doc_id, k, sha256(array_to_string(w[k:k + 19], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS k FROM d)),
again AS (SELECT doc_id, k FROM win QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, k) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 20)) AS place FROM again),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS place FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY place) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, place) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op11_license_scan": _licenses(),
    "op12_bit_sliced_negatives": f"""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings WHERE label IS NOT NULL AND {_WHOLE}),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS alike, list_inner_product(a.q, r.q)::BIGINT AS score FROM v a JOIN v r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT * FROM n WHERE rank <= 3""",
    "op13_ball_tree_clusters": _clusters(),
    "op10_ngram_jaccard_join": f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_SPACED}') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, sha256(array_to_string(w[k:k + 4], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
nodes AS (SELECT doc_id AS id FROM d), {_REACH}
SELECT id AS doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM comp LEFT JOIN size ON size.doc_id = id""",
}
