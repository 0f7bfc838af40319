"""DuckDB SQL for the queries that SQL can express within reasonable time on whole tables."""

OP1 = r"""
WITH low AS (SELECT item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT item_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
win AS (SELECT DISTINCT item_id, len(w[s:s + 12]) AS n, array_to_string(w[s:s + 12], ' ') AS k FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS s FROM iw WHERE len(w) > 0)),
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
pl AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT pl.doc_id, pl.s, pl.n, win.item_id FROM pl JOIN win ON win.k = pl.k AND win.n = pl.n),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN cov ON cov.doc_id = dw.doc_id LEFT JOIN its ON its.doc_id = dw.doc_id
"""
OP3 = r"""
WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 3], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS s FROM dw WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
ids AS (SELECT k, row_number() OVER () AS kid FROM sh GROUP BY k HAVING count(*) > 1),
small AS (SELECT sh.doc_id, ids.kid FROM sh JOIN ids ON ids.k = sh.k),
pr AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM small a JOIN small b ON a.kid = b.kid AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pr JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a AS u, b AS v FROM link UNION ALL SELECT b, a FROM link),
r AS (SELECT DISTINCT u, u AS z FROM e UNION SELECT e.v, r.z FROM r JOIN e ON e.u = r.u WHERE r.z < e.v),
c AS (SELECT u, min(z) AS z FROM r GROUP BY u)
SELECT dw.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.z, dw.doc_id) AS component_id, coalesce(c.z, dw.doc_id) = dw.doc_id AS kept
FROM dw LEFT JOIN n ON n.doc_id = dw.doc_id LEFT JOIN c ON c.u = dw.doc_id
"""
OP10 = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
pl AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM dw WHERE len(w) >= 50)),
lo AS (SELECT k, min(doc_id) AS lo FROM pl GROUP BY k HAVING count(*) > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS g FROM (SELECT pl.doc_id, unnest(range(pl.s, pl.s + 50)) AS p FROM pl JOIN lo ON lo.k = pl.k WHERE lo.lo < pl.doc_id) GROUP BY doc_id),
pos AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM dw),
cut AS (SELECT doc_id, unnest(g) AS p FROM gone),
left_ AS (SELECT pos.doc_id, string_agg(x, ' ' ORDER BY pos.p) AS t FROM pos ANTI JOIN cut ON cut.doc_id = pos.doc_id AND cut.p = pos.p GROUP BY pos.doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM dw LEFT JOIN gone ON gone.doc_id = dw.doc_id LEFT JOIN left_ ON left_.doc_id = dw.doc_id
"""

ORACLE_SQL = {"op1_decontaminate": OP1, "op3_near_dedup": OP3, "op10_recompression": OP10}
