"""Queries of fusion, mixed-space search, cascade and the truncation grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from vektrail.operators import knn, serving, truncation
from vektrail.operators.adapters import Calibrator
from vektrail.plans.fixtures import GRADES, IS_QUERY, SPACES, grades, new, old, search_sql, shear
from vektrail.plans.models import rotation

# fixed values: knots of the calibrator that both engines use
KNOTS = Calibrator((-0.2, 0.1, 0.4, 0.9), (0.0, 0.05, 0.5, 1.0))


def _hits(s, d, space, k):
    return knn.top_k(space(s, d).where(IS_QUERY), old(s, d), k).withColumnRenamed("doc_id", "id")


def _edge(rows):
    return rows.withColumn("score", F.round("score", 6))


def srv_rrf(s, d):
    return serving.rrf(_hits(s, d, old, 10), _hits(s, d, shear, 10)).withColumn("score", F.round("score", 9))


def srv_calibrated_merge(s, d):
    return _edge(serving.calibrated_merge(_hits(s, d, shear, 10), _hits(s, d, old, 5), KNOTS))


def srv_mixed_search(s, d):
    done = old(s, d).where("id % 10 < 4").select("id")
    total = old(s, d).count()
    return _edge(serving.mixed_search(old(s, d).where(IS_QUERY), new(s, d).where(IS_QUERY), old(s, d), new(s, d), done, 10, total, KNOTS))


def srv_cascade(s, d):
    fresh = old(s, d).where("id % 4 <> 0")
    return _edge(serving.cascade(_hits(s, d, shear, 30), old(s, d), fresh, 10))


def srv_bridge(s, d):
    mapped = serving.bridge(new(s, d).where(IS_QUERY), rotation())
    return _edge(knn.top_k(mapped, old(s, d), 5))


def srv_filtered_rerank(s, d):
    kept = _hits(s, d, shear, 30).join(old(s, d).where("label < 5").select("id"), "id", "left_semi")
    return _edge(serving.rerank(kept, "rank"))


def grid_truncation(s, d):
    base = old(s, d)
    got = truncation.grid(base.where(IS_QUERY), base, grades(s, d), 64, [64, 16], ["float32", "int8", "binary"])
    return got.select("dim", "precision", F.round("retained", 6).alias("retained"), F.round("rescored", 6).alias("rescored"), "storage")


def grid_cheapest(s, d):
    return truncation.cheapest_above(grid_truncation(s, d), 0.5)


QUERIES = {f.__name__: f for f in (srv_rrf, srv_calibrated_merge, srv_mixed_search, srv_cascade, srv_bridge, srv_filtered_rerank, grid_truncation, grid_cheapest)}

_Q = "(SELECT * FROM {0} WHERE id % 5 = 0)"
_KNOT = "CASE WHEN {0} <= -0.2 THEN 0.0 WHEN {0} >= 0.9 THEN 1.0 WHEN {0} < 0.1 THEN 0.05 * ({0} + 0.2) / 0.3 WHEN {0} < 0.4 THEN 0.05 + 0.45 * ({0} - 0.1) / 0.3 ELSE 0.5 + 0.5 * ({0} - 0.4) / 0.5 END"


def _merge(old_rows: str, new_rows: str, limit: str = "") -> str:
    return f"""
u AS (SELECT query_id, id, round({_KNOT.format('score')}, 9) AS score, rank, 0 AS side FROM {old_rows} UNION ALL SELECT query_id, id, score, rank, 1 FROM {new_rows}),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY score DESC, side, rank) AS bn FROM u) WHERE bn = 1),
f AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, id) - 1 AS rank FROM b)
SELECT query_id, id, round(score, 6) AS score, rank FROM f {limit}"""


ORACLES = {
    "srv_rrf": f"""WITH {SPACES}, {search_sql('a', _Q.format('old'), 'old', 10)}, {search_sql('b', _Q.format('shear'), 'old', 10)},
u AS (SELECT query_id, doc_id, rank FROM a UNION ALL SELECT query_id, doc_id, rank FROM b),
f AS (SELECT query_id, doc_id AS id, round(sum(1.0::DOUBLE / (61 + rank)), 12) AS score FROM u GROUP BY query_id, doc_id)
SELECT query_id, id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM f""",
    "srv_calibrated_merge": f"""WITH {SPACES}, {search_sql('a0', _Q.format('shear'), 'old', 10)}, {search_sql('n0', _Q.format('old'), 'old', 5)},
a AS (SELECT query_id, doc_id AS id, score, rank FROM a0), n AS (SELECT query_id, doc_id AS id, score, rank FROM n0), {_merge('a', 'n')}""",
    "srv_mixed_search": f"""WITH {SPACES}, z AS (SELECT count(*) AS t, count(*) FILTER (id % 10 < 4) AS m FROM old),
a1 AS (SELECT q.id AS query_id, d.id AS doc_id, round(list_dot_product(q.v, d.v), 9) AS score, row_number() OVER (PARTITION BY q.id ORDER BY round(list_dot_product(q.v, d.v), 9) DESC, d.id) - 1 AS rank FROM {_Q.format('old')} q, old d),
n1 AS (SELECT q.id AS query_id, d.id AS doc_id, round(list_dot_product(q.v, d.v), 9) AS score, row_number() OVER (PARTITION BY q.id ORDER BY round(list_dot_product(q.v, d.v), 9) DESC, d.id) - 1 AS rank FROM {_Q.format('new')} q, new d),
a AS (SELECT query_id, doc_id AS id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS rank FROM a1, z WHERE rank < least(floor(10 / (1 - m::DOUBLE / t)) + 1, 80) AND doc_id % 10 >= 4),
n AS (SELECT query_id, doc_id AS id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS rank FROM n1, z WHERE rank < least(floor(10 / (m::DOUBLE / t)) + 1, 80) AND doc_id % 10 < 4), {_merge('a', 'n', 'WHERE rank < 10')}""",
    "srv_cascade": f"""WITH {SPACES}, {search_sql('c', _Q.format('shear'), 'old', 30)},
s AS (SELECT c.query_id, c.doc_id AS id, c.score AS first, c.rank, CASE WHEN c.doc_id % 4 <> 0 THEN round(list_dot_product(q.v, d.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(d.v, d.v))), 9) END AS fresh
  FROM c JOIN old q ON q.id = c.query_id JOIN old d ON d.id = c.doc_id),
l AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS slot, row_number() OVER (PARTITION BY query_id ORDER BY fresh DESC, rank) AS i FROM s WHERE fresh IS NOT NULL),
p AS (SELECT a.query_id, a.id, a.fresh AS score, b.rank FROM l a JOIN l b ON a.query_id = b.query_id AND a.i = b.slot UNION ALL SELECT query_id, id, first, rank FROM s WHERE fresh IS NULL)
SELECT query_id, id, round(score, 6) AS score, rank FROM p WHERE rank < 10""",
    "srv_bridge": f"WITH {SPACES}, {search_sql('r', _Q.format('old'), 'old', 5, score='list_dot_product(q.v, d.v) / sqrt(list_dot_product(q.v, q.v))')} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r",
    "srv_filtered_rerank": f"WITH {SPACES}, {search_sql('c', _Q.format('shear'), 'old', 30)} SELECT query_id, doc_id AS id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS rank FROM c JOIN old d ON d.id = c.doc_id WHERE d.label < 5",
}


def _unit(v: str) -> str:
    return f"list_transform({v}, lambda x: x / greatest(sqrt(list_dot_product({v}, {v})), 1e-12))"


_CODES = {
    "float32": "{v}",
    "int8": "list_transform({v}, lambda x: round_even(x / list_max(list_transform({v}, lambda y: abs(y))) * 127, 0) / 127 * list_max(list_transform({v}, lambda y: abs(y))))",
    "binary": "list_transform({v}, lambda x: CASE WHEN x >= 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END)",
}


def _grid_sql() -> str:
    parts = [f"WITH {SPACES}, {GRADES}", "ideal AS (SELECT query_id, sum(grade / log2(rn + 1)) AS best FROM (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS rn FROM qrels) WHERE rn <= 10 GROUP BY query_id)"]
    parts.append(search_sql("base", _Q.format("old"), "old", 10, mask=True))
    score = "(SELECT avg(coalesce(d, 0) / i.best) FROM ideal i LEFT JOIN (SELECT r.query_id, sum(q.grade / log2(r.rank + 2)) AS d FROM {0} r JOIN qrels q ON q.query_id = r.query_id AND q.doc_id = r.doc_id WHERE r.rank < 10 GROUP BY r.query_id) g ON g.query_id = i.query_id)"
    rows = []
    for dim in (64, 16):
        for precision, bytes_ in (("float32", 4), ("int8", 1), ("binary", 0.125)):
            n = f"{precision}{dim}"
            parts.append(f"t{n} AS (SELECT id, {'v' if dim == 64 else _unit('v[1:16]')} AS v FROM old)")
            parts.append(f"c{n} AS (SELECT id, {_CODES[precision].format(v='v')} AS v FROM t{n})")
            parts.append(search_sql(f"f{n}", _Q.format(f"c{n}"), f"c{n}", 200, mask=True))
            parts.append(f"a{n} AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM (SELECT f.query_id, f.doc_id, round(list_dot_product(q.v, d.v), 9) AS score FROM f{n} f JOIN old q ON q.id = f.query_id JOIN old d ON d.id = f.doc_id))")
            rows.append(f"SELECT {dim} AS dim, '{precision}' AS precision, round({score.format('f' + n)} / {score.format('base')}, 6) AS retained, round({score.format('a' + n)} / {score.format('base')}, 6) AS rescored, {dim} / 64 * {bytes_} / 4 AS storage")
    return ", ".join(parts) + " " + " UNION ALL ".join(rows)


ORACLES["grid_truncation"] = _grid_sql()
ORACLES["grid_cheapest"] = f"SELECT * FROM ({ORACLES['grid_truncation']}) WHERE retained >= 0.5 ORDER BY storage, retained DESC, dim, precision LIMIT 1"
