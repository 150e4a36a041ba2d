"""SQL that states the same results, for the queries that SQL can express."""

from __future__ import annotations

OP2 = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)) AS vec
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.vec, x.vec)::BIGINT AS score
    FROM v q JOIN v x ON q.vec_id <> x.vec_id AND len(q.vec) = len(x.vec)
    WHERE q.vec_id % 20 = 0),
r AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank
    FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP5 = r"""
WITH d AS (
    SELECT doc_id, source,
           len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS size
    FROM documents),
s AS (
    SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
    SELECT *, 3.0::DOUBLE * source_size AS cap,
           [5, 2, 1][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)]::DOUBLE AS weight
    FROM s),
l AS (
    SELECT *,
           (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0))
           / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
    FROM w
    WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
    SELECT source, source_size, least(cap, max(CASE WHEN level * weight <= cap THEN level END) OVER () * weight) AS target
    FROM l),
e AS (
    SELECT d.*, t.source_size, t.target,
           CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size * 16777216 + 0.5)::BIGINT
                ELSE 16777216 END AS expected,
           ('0x' || substr(md5(coalesce(d.source, '')), 1, 6))::BIGINT AS off
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (
    SELECT *, off + sum(expected) OVER (
               PARTITION BY source
               ORDER BY len(bin(size)), substr(bin(size), 1, 4), substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 2),
                        size, doc_id NULLS LAST ROWS UNBOUNDED PRECEDING) AS upto
    FROM e)
SELECT doc_id, size, source_size, target,
       ((upto // 16777216 - (upto - expected) // 16777216) * size)::BIGINT AS taken
FROM p
"""

# Every run of at least 50 words is compared as text; those with an earlier equal one are deleted.
OP8 = r"""
WITH n AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
           generate_subscripts(string_split(text, chr(10)), 1) AS no
    FROM documents),
c AS (
    SELECT *, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS w FROM n),
l AS (
    SELECT doc_id, line, no, w, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS n,
           sum(w) OVER (PARTITION BY doc_id ORDER BY no) AS upto
    FROM c WHERE w > 0),
f AS (
    SELECT a.doc_id, a.n, min(b.n) AS stop
    FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.n >= a.n AND b.upto - a.upto + a.w >= 50
    GROUP BY ALL),
g AS (
    SELECT b.doc_id, max(a.n) AS n, b.n AS stop
    FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.n >= a.n AND b.upto - a.upto + a.w >= 50
    GROUP BY b.doc_id, b.n),
r AS (SELECT * FROM f UNION SELECT * FROM g),
t AS (
    SELECT r.doc_id, r.n, r.stop, string_agg(l.line, chr(10) ORDER BY l.n) AS content
    FROM r JOIN l ON l.doc_id = r.doc_id AND l.n BETWEEN r.n AND r.stop
    GROUP BY ALL),
k AS (
    SELECT *, min((doc_id, n)) OVER (PARTITION BY content) AS first_place FROM t),
gone AS (
    SELECT DISTINCT l.doc_id, l.no
    FROM k JOIN l ON l.doc_id = k.doc_id AND l.n BETWEEN k.n AND k.stop
    WHERE first_place < (k.doc_id, k.n)),
kept AS (
    SELECT c.doc_id, string_agg(c.line, chr(10) ORDER BY c.no) FILTER (WHERE gone.no IS NULL) AS text,
           count(gone.no) AS n_deleted
    FROM c LEFT JOIN gone ON gone.doc_id = c.doc_id AND gone.no = c.no
    GROUP BY c.doc_id)
SELECT d.doc_id, coalesce(k.n_deleted, 0)::BIGINT AS n_deleted,
       CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

OP12 = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS vec
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS same,
           list_inner_product(a.vec, x.vec)::BIGINT AS score
    FROM v a JOIN v x ON a.vec_id <> x.vec_id AND len(a.vec) = len(x.vec)
    WHERE a.vec_id % 100 = 0),
p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score
    FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
            AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""

ORACLE: dict[str, str] = {
    "op2_topk_search": OP2,
    "op5_mix_sources": OP5,
    "op8_line_dedup": OP8,
    "op12_hard_negatives": OP12,
}
