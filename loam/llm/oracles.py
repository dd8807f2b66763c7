"""DuckDB SQL of operators whose whole result SQL can say, if slowly."""

from __future__ import annotations

OP6_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, s, md5(substr(h, 2 * s + 1, 800)) AS m FROM (SELECT r, h, unnest(range(len(h) // 2 - 399)) AS s FROM d WHERE len(h) // 2 >= 400)),
twice AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
hit AS (SELECT r, s, s + 400 AS e FROM w JOIN twice USING (m)),
marked AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY r ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM hit),
run AS (SELECT *, sum(fresh) OVER (PARTITION BY r ORDER BY s) AS g FROM marked),
span AS (SELECT r, min(s) AS s, max(e) AS e FROM run GROUP BY r, g),
removed AS (SELECT r, CAST(sum(e - s) AS BIGINT) AS n_removed, count(*) AS n_spans FROM span GROUP BY r),
edge AS (SELECT r, s, e FROM span UNION ALL SELECT r, len(h) // 2, len(h) // 2 FROM d),
gap AS (SELECT r, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s, e), 0) AS a, s AS b FROM edge),
kept AS (SELECT r, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS k FROM gap JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (r) LEFT JOIN removed USING (r)
"""

OP7_SQL = r"""
WITH RECURSIVE copies AS (SELECT text AS t, min(doc_id) AS c FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) GROUP BY 1),
ws AS (SELECT c, list_filter(regexp_split_to_array(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x : x <> '') AS w FROM copies),
sh AS (SELECT DISTINCT c, hash(array_to_string(w[i:i + 4], ' ')) AS s FROM (SELECT c, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM ws WHERE len(w) > 0)),
n AS (SELECT c, count(*) AS n FROM sh GROUP BY c),
common AS (SELECT a.c AS a, b.c AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.c > b.c GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n x ON x.c = a JOIN n y ON y.c = b WHERE k >= 0.8 * (x.n + y.n - k)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT c AS node, c AS seen FROM copies UNION SELECT node, b FROM reach JOIN edge ON a = seen),
class AS (SELECT node, min(seen) AS class_id FROM reach GROUP BY node),
degree AS (SELECT a AS node, count(*) AS n_links FROM edge GROUP BY a)
SELECT doc_id, c AS copy_of, class_id, coalesce(n_links, 0) AS n_links FROM documents JOIN copies ON t = coalesce(text, '') JOIN class ON class.node = c LEFT JOIN degree ON degree.node = c
"""
