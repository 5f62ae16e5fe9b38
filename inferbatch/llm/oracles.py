"""Comparison SQL (DuckDB) of the operators SQL can express."""

from inferbatch.llm.exact_dedup import UPPER
from inferbatch.llm.mixing import CAP, SEED

_NORM = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"

EXACT_DEDUP = f"""
WITH t AS (SELECT doc_id, {_NORM} AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""


MIXING = f"""
WITH d AS (SELECT doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS weight,
    row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS rank, source_size * {CAP} AS most FROM s),
c AS (SELECT *, sum(most) OVER q AS held, sum(weight) OVER q AS used,
    sum(source_size) OVER () AS total, sum(weight) OVER () AS weights
    FROM w WINDOW q AS (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT (total - coalesce(held, 0))::DOUBLE / (weights - coalesce(used, 0))::DOUBLE AS level, most, weight, rank FROM c),
v AS (SELECT level FROM l WHERE most >= level * weight ORDER BY most / weight, rank LIMIT 1),
t AS (SELECT w.*, least(most::DOUBLE, (SELECT level FROM v) * weight) AS target FROM w),
p AS (SELECT d.doc_id, t.rank, d.size, t.source_size, t.target,
    md5('{SEED}:' || coalesce(d.doc_id::VARCHAR, 'null')) AS key,
    CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
g AS (SELECT *, floor(target - whole * source_size + 0.5)::BIGINT AS gap,
    sum(size) OVER (PARTITION BY rank ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM p)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, gap - upto + size)))::BIGINT AS taken FROM g
"""

WARC = """
WITH t AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
    sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM t WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT t.page_id, payload_bytes, t.payload_digest,
    CASE WHEN first_id IS NULL OR t.page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN first_id IS NULL OR t.page_id IS NOT DISTINCT FROM first_id THEN NULL ELSE first_id END AS refers_to
FROM t LEFT JOIN f ON t.payload_digest = f.payload_digest
"""

EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
good AS MATERIALIZED (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(e, lambda x: x <> 0))),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
    AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id, vec_id AS other FROM v UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = c.vec_id) AS n_links, component_id,
    vec_id = component_id AS kept
FROM (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id) c
"""

HARD_NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding::DOUBLE[] AS e
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
x AS MATERIALIZED (SELECT vec_id, label, list_transform(e, lambda c: floor(256 * c)::BIGINT) AS x FROM v
    WHERE len(e) > 0 AND list_bool_and(list_transform(e, lambda c: c IS NOT NULL AND isfinite(c)))),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * b.x[i]))::BIGINT AS score
    FROM x a JOIN x b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.other_id AS positive_id,
    (row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id))::INTEGER AS rank,
    n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""
