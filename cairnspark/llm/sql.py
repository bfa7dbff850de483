"""DuckDB SQL of the queries that SQL can express; each judges whole texts and works on whole tables."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLDED = f"translate(text, '{UPPER}', '{LOWER}')"

#: Five characters of the hex digest are twenty bits, that is, four of base32.
WARC = """
WITH page AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
hashed AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS h FROM page),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS least FROM hashed)
SELECT page_id, payload_bytes,
    array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, 1 + 5 * (k // 4), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS INT), 1)), '') AS payload_digest,
    CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to
FROM firsts
"""

JACCARD = f"""
WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all(coalesce({FOLDED}, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingle AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda k: array_to_string(w[k:k + 4], ' '))) AS s FROM worded WHERE len(w) > 0)),
sized AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN sized x ON x.doc_id = a.doc_id JOIN sized y ON y.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(first, doc_id)) AS component_id
FROM worded LEFT JOIN sized USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS first FROM reach GROUP BY a) USING (doc_id)
"""

#: Bytes are pairs of hex digits; strings of 50 bytes meet by a 128-bit hash of them.
DEDUP = """
WITH body AS (SELECT row_number() OVER () AS r, doc_id, hex(coalesce(text, '')) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
start AS (SELECT r, doc_id, c.k AS k, c.s AS s FROM (SELECT r, doc_id, unnest(list_transform(range(0, n - 49), lambda k: {'k': k, 's': md5_number(substr(h, 2 * k + 1, 100))})) AS c FROM body WHERE n >= 50)),
again AS (SELECT r, k FROM (SELECT *, min(doc_id) OVER (PARTITION BY s) AS least FROM start) WHERE doc_id > least),
run AS (SELECT r, min(k) AS lo, max(k) + 50 AS hi FROM (SELECT *, sum(fresh) OVER (PARTITION BY r ORDER BY k) AS g FROM (SELECT *, CASE WHEN k <= lag(k) OVER (PARTITION BY r ORDER BY k) + 50 THEN 0 ELSE 1 END AS fresh FROM again)) GROUP BY r, g),
piece AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS came FROM run),
kept AS (SELECT r, CAST(sum(hi - lo) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * came + 1, 2 * (lo - came)), '' ORDER BY lo) || substr(any_value(h), 2 * max(hi) + 1) AS rest FROM piece JOIN body USING (r) GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256 FROM body LEFT JOIN kept USING (r)
"""

WORDS = f"regexp_extract_all(coalesce({FOLDED}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
LEAKS = f"""
WITH item AS (SELECT item_id, w, least(10, len(w)) AS l FROM (SELECT item_id, {WORDS} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, l, unnest(list_transform(range(1, len(w) - l + 2), lambda k: array_to_string(w[k:k + l - 1], ' '))) AS s FROM item),
doc AS (SELECT doc_id, {WORDS} AS w FROM documents),
place AS (SELECT doc_id, l, c.k AS k, c.s AS s FROM (SELECT doc_id, l, unnest(list_transform(range(1, len(w) - l + 2), lambda k: {{'k': k, 's': array_to_string(w[k:k + l - 1], ' ')}})) AS c FROM doc, (SELECT DISTINCT l FROM win) WHERE len(w) >= l)),
hit AS (SELECT doc_id, item_id, k, l FROM place JOIN win USING (l, s)),
word AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + l)) AS p FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(word.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, word.n IS NOT NULL AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN named USING (doc_id)
"""

#: Scores are sums of whole numbers; every anchor meets every row.
NEGATIVES = """
WITH part AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same, CAST(coalesce(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score FROM part a JOIN part c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v)),
positive AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pair WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INT) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN pair USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score QUALIFY rank <= 5
"""

ORACLE_SQL = {
    "op2_warc_zip": WARC,
    "op4_heavy_light_jaccard": JACCARD,
    "op5_bucket_pointer_dedup": DEDUP,
    "op7_positional_decontamination": LEAKS,
    "op13_four_russians_negatives": NEGATIVES,
}
