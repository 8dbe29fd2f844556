"""SQL for the queries that SQL can express."""

SUBSTRING_DEDUP = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w)),
least AS (SELECT k, min(doc_id) AS d FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN least USING (k) WHERE d < doc_id),
word AS (SELECT doc_id, w[p] AS word, p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM w)),
kept AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id),
text AS (SELECT word.doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY word.doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN text USING (doc_id)
"""

WARC = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((((strpos('0123456789abcdef', substr(hex, 5 * i // 4 + 1, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(hex, 5 * i // 4 + 2, 1)) - 1) >> (3 - i % 4)) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to
FROM p
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS k, count(*) AS n FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w) GROUP BY ALL),
size AS (SELECT doc_id, sum(n) AS n FROM g GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS n FROM g a JOIN g b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared s JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE s.n >= 0.8 * (x.n + y.n - s.n)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS node FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON e.a = r.node)
SELECT doc_id, min(node) AS class_id, min(node) = doc_id AS kept FROM reach GROUP BY doc_id
"""

SUFFIX_DEDUP = """
WITH d AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS MATERIALIZED (SELECT doc_id, p, md5(b[p + 1:p + 200]) AS k FROM (SELECT doc_id, b, unnest(range(0, octet_length(b) - 199)) AS p FROM d)),
hit AS (SELECT doc_id, p FROM w SEMI JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
run AS (SELECT doc_id, min(p) AS low, max(p) + 200 AS high FROM (
    SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS r
    FROM (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200 THEN 0 ELSE 1 END AS fresh FROM hit)) GROUP BY doc_id, r),
gap AS (SELECT doc_id, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS a, low AS z FROM (SELECT * FROM run UNION ALL SELECT doc_id, octet_length(b), NULL FROM d)),
kept AS (SELECT doc_id, list_reduce(list(b[a + 1:z] ORDER BY a), lambda x, y: x || y) AS kept FROM gap JOIN d USING (doc_id) GROUP BY doc_id),
gone AS (SELECT doc_id, sum(high - low) AS n_removed, count(*) AS n_spans FROM run GROUP BY doc_id)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(kept) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)
"""
