"""SQL that gives the rows of a query by brute force, for those queries that it can express."""

OP1_MINHASH_DEDUP = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, ws[i] || ' ' || ws[i + 1] AS sh FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM w WHERE len(ws) > 1)
  UNION ALL SELECT doc_id, ws[1] FROM w WHERE len(ws) = 1
), size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
pairs AS (SELECT u, v FROM common JOIN size x ON x.doc_id = u JOIN size y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
links AS (SELECT u, v FROM pairs UNION ALL SELECT v, u FROM pairs),
reach(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.u, r.root FROM reach r JOIN links l ON l.v = r.id),
low AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(size.n, 0) AS n_shingles, low.root AS component_id, d.doc_id = low.root AS kept
FROM documents d JOIN low ON low.id = d.doc_id LEFT JOIN size ON size.doc_id = d.doc_id
"""

OP10_EMBEDDING_DEDUP = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), n AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS size FROM v WHERE list_inner_product(e, e) > 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / (a.size * b.size) >= 0.98
), reach(id, root) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT l.u, r.root FROM reach r JOIN links l ON l.v = r.id
), low AS (SELECT id, min(root) AS root FROM reach GROUP BY id), many AS (SELECT u, count(DISTINCT v) AS n FROM links GROUP BY u)
SELECT e.vec_id, CAST(coalesce(many.n, 0) AS BIGINT) AS n_links, low.root AS component_id, e.vec_id = low.root AS kept
FROM embeddings e JOIN low ON low.id = e.vec_id LEFT JOIN many ON many.u = e.vec_id
"""
