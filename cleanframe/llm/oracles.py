"""SQL for DuckDB that gives the rows of the queries that SQL can express, by plain joins of all occurrences."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Windows of ten words of the items, held against every run of as many words of every document.
CONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, list_slice(w, p, p + 9) AS phrase
  FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(p) WHERE len(w) > 0),
runs AS (
  SELECT doc_id, p, n, list_slice(w, p, p + n - 1) AS phrase
  FROM d, (SELECT DISTINCT len(phrase) AS n FROM win) AS k, unnest(range(1, len(w) - n + 2)) AS t(p)),
found AS (SELECT doc_id, p, n, item_id FROM runs JOIN win USING (phrase)),
hit AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""

#: All pairs that share a three-word shingle, then reachability over the links.
SHINGLE_CLASSES = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, list_slice(w, p, p + 2) AS g
  FROM d, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS t(p) WHERE len(w) > 0),
n AS (SELECT doc_id, count(g) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY doc_id),
both_hold AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (
  SELECT x, y FROM both_hold JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y
  WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.other)
SELECT n.doc_id, n.n AS n_shingles, min(other) AS component_id FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY 1, 2"""

#: Cosine of all pairs of a label, then reachability.
VECTOR_CLASSES = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(vec_id, other) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.y FROM r JOIN l ON l.x = r.other)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.x = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN (SELECT vec_id, min(other) AS component_id FROM r GROUP BY vec_id) AS c ON c.vec_id = v.vec_id"""
