"""SQL for DuckDB, for the queries of this subpackage that SQL can express: 2, 4, 6 and 11.

The others have none: text out of HTML (1), bootstrapping and trained models over places in code points (3, 7),
tokenizers' merges (5, 10, 13), merged diagonals (8), expectation-maximisation (9) and a
trained network (12).
"""

from __future__ import annotations

REPEATS = """
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, encode(coalesce(text, '')) AS b FROM documents),
hexed AS (SELECT doc_id, r, hex(b) AS h, octet_length(b) AS n FROM docs),
hashed AS (SELECT r, unnest(range(n - 199)) AS s, unnest([md5(substring(h, CAST(2 * i + 1 AS BIGINT), 400)) for i in range(n - 199)]) AS w FROM hexed WHERE n >= 200),
twice AS (SELECT w FROM hashed GROUP BY w HAVING count(*) > 1),
marked AS (SELECT r, s, CASE WHEN s - lag(s) OVER (PARTITION BY r ORDER BY s) <= 200 THEN 0 ELSE 1 END AS new FROM hashed SEMI JOIN twice USING (w)),
numbered AS (SELECT r, s, sum(new) OVER (PARTITION BY r ORDER BY s) AS g FROM marked),
runs AS (SELECT r, g, min(s) AS lo, max(s) + 200 AS hi FROM numbered GROUP BY r, g),
gaps AS (SELECT r, g, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS past FROM runs),
cut AS (SELECT r, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS last, string_agg(substring(h, CAST(2 * past + 1 AS BIGINT), CAST(2 * (lo - past) AS BIGINT)), '' ORDER BY lo) AS kept FROM gaps JOIN hexed USING (r) GROUP BY r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN n_removed IS NULL THEN h ELSE kept || substring(h, CAST(2 * last + 1 AS BIGINT)) END)) AS kept_sha256
FROM hexed LEFT JOIN cut USING (r)
"""

VECTORS = """
WITH RECURSIVE fine AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach(vec_id, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.r),
lowest AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM lowest LEFT JOIN counts USING (vec_id)
"""

SHINGLES = r"""
WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) END AS s FROM split),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM each a JOIN each b ON a.x = b.x AND a.doc_id <> b.doc_id WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * c >= 85 * (na + nb - c)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM sets UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r),
lowest AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN lowest USING (doc_id)
"""


TRIE = r"""
WITH own AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS r
  FROM conversations WHERE conv_id IS NOT NULL),
each AS (
  SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0] for x in string_split(c::VARCHAR, '')])), lambda s, x: xor(xor(s, x) >> 1, (xor(s, x) & 1) * 3988292384::BIGINT)), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT c FROM own)),
built AS (
  SELECT e.c, 0 AS part, r, role, text FROM each e JOIN own o ON o.c = e.c - e.c % 20 AND r <= h
  UNION ALL SELECT e.c, 1, r, role, text FROM each e JOIN own o ON o.c = e.c AND r > h),
placed AS (SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY part, r) AS d FROM built),
members AS (
  SELECT c, d, list({'role': role, 'text': text}) OVER (PARTITION BY c ORDER BY d) AS k, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM placed
  UNION ALL SELECT c, 0, [], 0 FROM each),
nodes AS (SELECT d, k, min(c) AS id, count(*) AS n, min(w) AS w FROM members GROUP BY d, k),
family AS (SELECT u.id, u.d, p.id AS up FROM nodes u LEFT JOIN nodes p ON p.d = u.d - 1 AND p.k = u.k[:u.d - 1] AND u.d > 0),
born AS (SELECT up AS id, d - 1 AS d, count(*) AS n_children FROM family WHERE d > 0 GROUP BY ALL),
full_nodes AS (SELECT nodes.*, up, coalesce(n_children, 0) AS n_children FROM nodes JOIN family USING (id, d) LEFT JOIN born USING (id, d)),
sums AS (
  SELECT a.id, a.d, sum(CASE WHEN u.n_children = 0 THEN 1 ELSE 0 END) AS leaves, sum((u.n - 1) * u.w) AS saved
  FROM full_nodes u JOIN members m ON m.c = u.id AND m.d <= u.d JOIN nodes a ON a.d = m.d AND a.k = m.k GROUP BY ALL),
last AS (SELECT c, max(d) AS d FROM members GROUP BY c),
ended AS (SELECT n.id, n.d, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM last JOIN members m USING (c, d) JOIN nodes n ON n.d = m.d AND n.k = m.k GROUP BY ALL)
SELECT id AS conv_id, d::BIGINT AS depth, up AS parent_conv_id, n::BIGINT AS n_convs, n_children::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM full_nodes JOIN sums USING (id, d) LEFT JOIN ended USING (id, d)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_array_dedup": REPEATS, "op4_embedding_near_dedup": VECTORS, "op6_minhash_near_dedup": SHINGLES, "op11_conversation_trie": TRIE}
