"""SQL for DuckDB that checks the queries which SQL can express."""

from __future__ import annotations

# A-Z to a-z alone; other letters stay.
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = f"""
WITH item AS (SELECT item_id, {WORDS} AS w FROM benchmark),
doc AS (SELECT doc_id, {WORDS} AS w FROM documents),
size AS (SELECT item_id, w, least(len(w), 10) AS n FROM item WHERE len(w) > 0),
pattern AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS p
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM size)),
place AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS p
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM doc, (SELECT DISTINCT n FROM pattern) WHERE len(w) >= n)),
found AS (SELECT doc_id, i, n, item_id FROM place JOIN pattern USING (n, p)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
           FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)
"""

# Five hex digits of a SHA-1 are four base32 characters.
BASE32 = """array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform(range(0, 4),
  lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(hex, (5 * i + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * j)::BIGINT) & 31)::BIGINT + 1, 1)), '')), '')"""

OP10 = f"""
WITH page AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
  sha1(coalesce(html, '')) AS hex FROM pages),
first AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS f FROM page)
SELECT page_id, payload_bytes, {BASE32} AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> f THEN f END AS refers_to
FROM first
"""

OP11 = """
WITH taken AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    list_dot_product(a.v, b.v)::BIGINT AS score
  FROM taken a JOIN taken b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positive AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
negative AS (
  SELECT p.*, id AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank
  FROM positive p JOIN scored s USING (anchor_id)
  WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score
FROM negative WHERE rank <= 10
"""

ORACLES: dict[str, str] = {
    "op1_decontamination": OP1,
    "op10_warc": OP10,
    "op11_hard_negatives": OP11,
}
