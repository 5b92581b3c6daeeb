"""DuckDB statements of the contracts that SQL can express, written apart from the operators."""

from __future__ import annotations

_WORDS = "list_filter(string_split_regex(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"

OP5 = f"""WITH d AS (SELECT doc_id, {_WORDS.format(t="coalesce(text, '')")} AS w FROM documents),
i AS (SELECT item_id, {_WORDS.format(t="coalesce(text, '')")} AS w FROM benchmark),
x AS (SELECT item_id, least(10, len(w)) AS n, unnest(list_transform(generate_series(1, len(w) - least(10, len(w)) + 1), lambda k: array_to_string(w[k : k + least(10, len(w)) - 1], ' '))) AS g FROM i WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM x),
g AS (SELECT doc_id, n, list_transform(generate_series(1, len(w) - n + 1), lambda k: array_to_string(w[k : k + n - 1], ' ')) AS gs FROM d, ns WHERE len(w) >= n),
p AS (SELECT doc_id, n, unnest(gs) AS g, unnest(generate_series(1, len(gs))) AS pos FROM g),
h AS (SELECT p.doc_id, p.pos, p.n, x.item_id FROM p JOIN x ON p.n = x.n AND p.g = x.g),
hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(pos, pos + n - 1)) AS k FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(CAST(len(ids) AS BIGINT), 0) AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)"""

OP7 = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages), s AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS head FROM s)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(generate_series(0, 31), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST(('0x' || substr(h, 1 + 5 * (k // 4), 5)) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> head THEN head END AS refers_to, TRUE AS whole FROM m"""

OP9 = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS node, vec_id AS low FROM embeddings UNION SELECT l.y, r.low FROM r JOIN l ON r.node = l.x WHERE r.low < l.y), c AS (SELECT node, min(low) AS component_id FROM r GROUP BY node)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.x = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON node = vec_id"""

#: Every window of 400 bytes by its MD5; what windows that occur twice cover is cut out of the bytes.
OP2 = """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), n AS (SELECT doc_id, b, octet_length(b) AS n FROM d),
w AS (SELECT doc_id, s, md5(b[s:s + 399]) AS h FROM (SELECT doc_id, b, unnest(range(1, n - 398)) AS s FROM n WHERE n >= 400)),
twice AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
hit AS (SELECT doc_id, s, s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS gap FROM w WHERE h IN (SELECT h FROM twice)),
runs AS (SELECT doc_id, s, sum(CASE WHEN gap IS NULL OR gap > 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM hit),
spans AS (SELECT doc_id, min(s) AS a, max(s) + 399 AS z FROM runs GROUP BY doc_id, run),
edges AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
cut AS (SELECT e.doc_id, sum(z - a + 1) AS removed, count(*) AS k, string_agg(CASE WHEN a > before + 1 THEN hex(b[before + 1:a - 1]) ELSE '' END, '' ORDER BY a) AS head, max(z) AS last FROM edges e JOIN n ON n.doc_id = e.doc_id GROUP BY e.doc_id)
SELECT n.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(k, 0) AS BIGINT) AS n_spans,
  sha256(CASE WHEN removed IS NULL THEN b ELSE unhex(head || CASE WHEN last < n THEN hex(b[last + 1:n]) ELSE '' END) END) AS kept_sha256, removed IS NOT NULL AS repeated FROM n LEFT JOIN cut ON n.doc_id = cut.doc_id"""
