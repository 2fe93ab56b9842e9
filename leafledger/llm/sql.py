"""SQL for DuckDB with the results of those numbered queries that it can express."""

from __future__ import annotations

MIX = """
WITH RECURSIVE
weight(source, k) AS (VALUES ('src0', 6), ('src1', 4), ('src2', 3)),
sources AS (
  SELECT source, coalesce(weight.k, 2) AS k FROM (SELECT DISTINCT source FROM documents) d LEFT JOIN weight USING (source)),
lists AS (SELECT list(source ORDER BY source) AS names, list(k ORDER BY source) AS ks, sum(k)::BIGINT AS period FROM sources),
edf(t, taken, pick) AS (
  SELECT 0::BIGINT, list_transform(ks, lambda k: 0::BIGINT), -1::BIGINT FROM lists
  UNION ALL
  SELECT t + 1, list_transform(range(len(taken)), lambda i: taken[i + 1] + CASE WHEN i = chosen THEN 1 ELSE 0 END), chosen
  FROM (
    SELECT t, taken, list_min(list_filter(list_transform(range(len(taken)), lambda i:
        CASE WHEN taken[i + 1] < ks[i + 1] AND (taken[i + 1] * period) // ks[i + 1] <= t
        THEN (((taken[i + 1] + 1) * period + ks[i + 1] - 1) // ks[i + 1]) * 1000000 + i END),
        lambda x: x IS NOT NULL)) % 1000000 AS chosen
    FROM edf, lists WHERE t < period)),
slots AS (
  SELECT names[pick + 1] AS source, t - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS nth
  FROM edf, lists WHERE pick >= 0),
placed AS (
  SELECT doc_id, source, length(text) AS size,
         coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM (SELECT *, md5(doc_id::VARCHAR || ':' || text) AS key FROM documents)),
blocks AS (SELECT p.*, before // 16384 AS block, k, period FROM placed p JOIN sources USING (source), lists)
SELECT doc_id, b.source, size::BIGINT AS size, block, (block * period) // k AS release,
       ((block + 1) * period + k - 1) // k AS deadline, (block // k) * period + slot AS slot, before AS "offset"
FROM blocks b JOIN slots s ON s.source = b.source AND s.nth = b.block % k
"""

LINES = """
WITH lines AS (
  SELECT doc_id, i, string_split(text, chr(10))[i] AS line, len(string_split(text, chr(10))) AS n
  FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i)),
marks AS (
  SELECT *, i > 1 AND ('0x' || substr(md5(lag(md5(line)) OVER w || md5(line)), 1, 7))::BIGINT % 3 = 0 AS mark
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
ends AS (
  SELECT *, i = n OR (mark AND i < n - 1 AND NOT lag(mark) OVER (PARTITION BY doc_id ORDER BY i)) AS last FROM marks),
numbered AS (
  SELECT *, coalesce(sum(last::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c
  FROM ends),
chunk AS (
  SELECT doc_id, c, string_agg(line, chr(10) ORDER BY i) AS part, count(*) AS size FROM numbered GROUP BY doc_id, c),
ranked AS (SELECT *, row_number() OVER (PARTITION BY part, size >= 2 ORDER BY doc_id, c) AS copy FROM chunk),
marked AS (SELECT *, size >= 2 AND copy > 1 AS lost FROM ranked)
SELECT doc_id, count(*) AS n_chunks, sum(lost::INT)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(part, chr(10) ORDER BY c) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

WARC = """
WITH page AS (
  SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS latest FROM pages),
digest AS (SELECT *, sha1(html) AS hex FROM page),
base32 AS (
  SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(hex, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT, 1), '' ORDER BY i) AS payload_digest
  FROM digest, range(32) AS t(i) GROUP BY page_id)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = latest THEN NULL ELSE latest END AS refers_to
FROM digest JOIN base32 USING (page_id)
"""

EMBEDDINGS = """
WITH RECURSIVE
valid AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM valid a JOIN valid b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
lowest AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM lowest LEFT JOIN degree USING (vec_id)
"""
