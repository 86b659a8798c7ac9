"""SQL for the training-data queries that SQL can express, as DuckDB runs it."""

from __future__ import annotations

MIXING = """
WITH RECURSIVE counts AS (SELECT coalesce(source, '') AS name, count(*) AS n FROM documents GROUP BY ALL),
share AS (SELECT name, n, sqrt(n) / sum(sqrt(n)) OVER () * 1000000 AS exact FROM counts),
base AS (SELECT name, n, exact, cast(floor(exact + 1e-6) AS BIGINT) AS base, 1000000 - sum(cast(floor(exact + 1e-6) AS BIGINT)) OVER () AS spare FROM share),
groups AS (SELECT name, n, greatest(1, cast(base + CASE WHEN row_number() OVER (ORDER BY round(exact - base, 6) DESC, name) <= spare THEN 1 ELSE 0 END AS BIGINT)) AS units, row_number() OVER (ORDER BY name) AS g FROM base),
u AS (SELECT list(units ORDER BY g) AS units, cast(sum(units) AS BIGINT) AS whole FROM groups),
needed AS (SELECT least((SELECT whole FROM u), max(((n + 15) // 16 * (SELECT whole FROM u) + units - 1) // units)) AS slots FROM groups),
sched(t, done, pick) AS (
    SELECT -1, list_transform(units, lambda x: cast(0 AS BIGINT)), cast(0 AS BIGINT) FROM u
    UNION ALL
    SELECT t + 1, list_transform(done, lambda d, i: d + CASE WHEN i = p THEN 1 ELSE 0 END), p
    FROM (SELECT t, done, list_sort(list_filter(list_transform(u.units, lambda x, i: CASE WHEN done[i] * whole // x <= t + 1 THEN {'due': ((done[i] + 1) * whole + x - 1) // x, 'i': i} END), lambda x: x IS NOT NULL))[1].i AS p FROM sched, u, needed WHERE t < slots - 1) q),
times AS (SELECT pick AS g, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) AS m FROM sched WHERE t >= 0),
ranked AS (SELECT doc_id, coalesce(source, '') AS name, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(cast(doc_id AS VARCHAR), '')), doc_id NULLS FIRST) - 1 AS r FROM documents),
placed AS (SELECT doc_id, r.name, units, g, r // 16 AS block, r % 16 AS place, (r // 16) // units AS turn, (r // 16) % units + 1 AS m FROM ranked r JOIN groups USING (name))
SELECT doc_id, name, p.units, block, turn * whole + slot AS slot, turn * whole + (p.m - 1) * whole // p.units AS release, turn * whole + (p.m * whole + p.units - 1) // p.units AS due, place
FROM placed p JOIN times t ON p.g = t.g AND p.m = t.m, u
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END) AS s FROM w),
e AS MATERIALIZED (SELECT doc_id, unnest(s) AS x FROM s),
rare AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM rare JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * m >= 80 * (len(x.s) + len(y.s) - m)),
pair AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT DISTINCT a, a AS b FROM pair UNION SELECT r.a, l.b FROM reach r JOIN pair l ON r.b = l.a),
root AS (SELECT a, min(b) AS root FROM reach GROUP BY a)
SELECT s.doc_id, cast(len(s) AS BIGINT) AS n_shingles, coalesce(root, s.doc_id) AS component_id, s.doc_id = coalesce(root, s.doc_id) AS kept FROM s LEFT JOIN root ON a = s.doc_id
"""

HARD_NEGATIVES = """
WITH e AS MATERIALIZED (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * cast(x AS DOUBLE))) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other, cast(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT anchor_id, positive_id, other AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, cast(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) <= 10
"""

ORACLES = {"op7_mixing": MIXING, "op10_near_duplicates": NEAR_DUPLICATES, "op12_hard_negatives": HARD_NEGATIVES}
