"""DuckDB twins of the queries that SQL can express: exact formulations over whole tables."""

from __future__ import annotations

_P1 = """
WITH d AS (SELECT side, max(CASE WHEN higher_is_better THEN 1.0 ELSE -1.0 END)::DOUBLE AS sign FROM sides GROUP BY side),
h AS (SELECT query_id, h0.side, id, max(CASE WHEN isfinite(score) THEN score END * coalesce(sign, 1.0)) AS s, min(rank)::DOUBLE AS rank FROM hits h0 LEFT JOIN d ON d.side = h0.side GROUP BY query_id, h0.side, id
  HAVING s IS NOT NULL OR min(rank) IS NOT NULL),
known AS (SELECT * FROM h WHERE s IS NOT NULL AND rank IS NOT NULL),
below AS (SELECT m.query_id, m.side, m.id, max(k.rank) AS rank, arg_max(k.s, (k.rank, k.s)) AS s FROM h m JOIN known k ON k.query_id = m.query_id AND k.side = m.side AND k.rank <= m.rank WHERE m.s IS NULL GROUP BY ALL),
above AS (SELECT m.query_id, m.side, m.id, min(k.rank) AS rank, arg_min(k.s, (k.rank, k.s)) AS s FROM h m JOIN known k ON k.query_id = m.query_id AND k.side = m.side AND k.rank >= m.rank WHERE m.s IS NULL GROUP BY ALL),
f AS (SELECT h.query_id, h.side, h.id, coalesce(h.s, CASE WHEN a.rank > b.rank THEN b.s + (a.s - b.s) * (h.rank - b.rank) / (a.rank - b.rank) END, b.s, a.s, -h.rank) AS s
  FROM h LEFT JOIN below b ON b.query_id = h.query_id AND b.side = h.side AND b.id = h.id LEFT JOIN above a ON a.query_id = h.query_id AND a.side = h.side AND a.id = h.id),
m AS (SELECT query_id, side, quantile_disc(s, 0.5) AS med, min(s) AS worst FROM f GROUP BY query_id, side),
u AS (SELECT f.query_id, f.side, quantile_disc(abs(s - med), 0.5) * 1.4826 AS mad, avg(abs(s - med)) AS off FROM f JOIN m ON m.query_id = f.query_id AND m.side = f.side GROUP BY f.query_id, f.side),
l AS (SELECT m.query_id, m.side, med, CASE WHEN mad > 0 THEN mad WHEN off > 0 THEN off ELSE 1.0 END AS unit, worst FROM m JOIN u ON u.query_id = m.query_id AND u.side = m.side),
z AS (SELECT query_id, side, med, unit, greatest(least((worst - med) / unit, 1e9), -1e9) - 1 AS last FROM l),
b AS (SELECT *, -(greatest(-last, 0) + ln(1 + exp(-abs(last)))) AS floor FROM z),
x AS (SELECT f.query_id, f.id, greatest(least((s - med) / unit, 1e9), -1e9) AS z, floor, last FROM f JOIN b ON b.query_id = f.query_id AND b.side = f.side),
g AS (SELECT query_id, id, count(*) AS n, sum(-(greatest(-z, 0) + ln(1 + exp(-abs(z))))) AS log, sum(z) AS z, sum(floor) AS floor, sum(last) AS last FROM x GROUP BY query_id, id),
w AS (SELECT query_id, sum(floor) AS floors, sum(last) AS lasts, count(*) AS sides FROM b GROUP BY query_id),
o AS (SELECT g.query_id, g.id, (log + CASE WHEN n = sides THEN 0 ELSE floors - floor END) / sides AS mean, (z + CASE WHEN n = sides THEN 0 ELSE lasts - last END) / sides AS z FROM g JOIN w ON w.query_id = g.query_id),
r AS (SELECT query_id, id, round(exp(mean), 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(-mean, 12), round(z, 6) DESC, id) AS place FROM o)
"""

P1 = f"{_P1} SELECT query_id, id FROM r WHERE place <= 5"
P1_RANKING = f"{_P1} SELECT query_id, id, score, place FROM r"

# the bits of a little-endian 32-bit float, from eight hex digits
_WORD = "('0x' || substr(x, 8 * i + 7, 2) || substr(x, 8 * i + 5, 2) || substr(x, 8 * i + 3, 2) || substr(x, 8 * i + 1, 2))::BIGINT"
_FLOAT = "(CASE WHEN w >= 2147483648 THEN -1 ELSE 1 END) * (CASE WHEN (w >> 23) & 255 = 255 THEN 'nan'::DOUBLE WHEN (w >> 23) & 255 = 0 THEN (w & 8388607) * pow(2::DOUBLE, -149) ELSE (8388608 + (w & 8388607)) * pow(2::DOUBLE, ((w >> 23) & 255) - 150) END)"
_USABLE = f"""
docs0 AS (SELECT doc_id, embedding, written_utc, row_number() OVER (PARTITION BY doc_id ORDER BY written_utc DESC NULLS LAST) AS rn FROM vec_documents WHERE doc_id IS NOT NULL),
raw AS (SELECT 'vec_documents' AS tab, doc_id::VARCHAR AS id, list_transform(embedding, lambda v: v::DOUBLE) AS v FROM docs0 WHERE rn = 1
  UNION ALL SELECT 'vectors', key, list_transform(list_transform(range(octet_length(vector) // 4), lambda i: {_WORD}), lambda w: {_FLOAT})
  FROM (SELECT DISTINCT key, vector, hex(vector) AS x FROM vectors WHERE key IS NOT NULL AND octet_length(vector) % 4 = 0)),
ok AS (SELECT tab, id, v FROM raw WHERE len(v) = 64 AND len(list_filter(v, lambda e: e IS NOT NULL AND isfinite(e))) = 64 AND len(list_filter(v, lambda e: e <> 0)) > 0),
unit AS (SELECT tab, id, list_transform(v, lambda e: e / sqrt(list_dot_product(v, v))) AS v FROM ok),
near AS (SELECT a.tab, a.id AS x, b.id AS y, round(list_dot_product(a.v, b.v), 9) AS cos FROM unit a JOIN unit b ON a.tab = b.tab AND a.id <> b.id WHERE list_dot_product(a.v, b.v) >= 0.86)"""

P3 = f"""
WITH {_USABLE}, best AS (SELECT tab, x, y FROM (SELECT *, row_number() OVER (PARTITION BY tab, x ORDER BY cos DESC, y) AS place FROM near) WHERE place <= 5)
SELECT DISTINCT tab, least(x, y) AS id_a, greatest(x, y) AS id_b FROM best
"""

P4 = f"""
WITH RECURSIVE {_USABLE},
reach(tab, x, y) AS (SELECT tab, x, x FROM near UNION SELECT r.tab, r.x, n.y FROM reach r JOIN near n ON n.tab = r.tab AND n.x = r.y),
c AS (SELECT tab, x AS id, min(y) AS cluster_id, count(*) AS size FROM reach GROUP BY tab, x)
SELECT tab, cluster_id, id FROM c WHERE size >= 3
"""

P4_CLUSTERS = P4.replace("SELECT tab, cluster_id, id FROM c WHERE size >= 3", """, k AS (SELECT c.*, u.v FROM c JOIN unit u ON u.tab = c.tab AND u.id = c.id WHERE size >= 3),
a AS (SELECT x.tab, x.cluster_id, x.size, x.id, round((sum(list_dot_product(x.v, y.v)) - 1) / (x.size - 1), 6) AS affinity
  FROM k x JOIN k y ON y.tab = x.tab AND y.cluster_id = x.cluster_id GROUP BY x.tab, x.cluster_id, x.size, x.id),
r AS (SELECT *, row_number() OVER (PARTITION BY tab, cluster_id ORDER BY affinity DESC, id) AS place FROM a)
SELECT tab, cluster_id, size, place, id, affinity FROM r WHERE place <= 3""")

P5 = """
WITH w AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS tok FROM w WHERE len(ws) >= 30),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.tok = b.tok AND a.doc_id < b.doc_id GROUP BY 1, 2)
SELECT a AS doc_a, b AS doc_b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE o >= 0.5 * (x.n + y.n - o)
"""

ORACLES = {"p1_found": P1, "p1_ranking": P1_RANKING, "p3_found": P3, "p4_found": P4, "p4_clusters": P4_CLUSTERS, "p5_found": P5}
