"""Queries of vector functions, scans and nearest-neighbour kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from vektrail.functions import vec
from vektrail.operators import knn
from vektrail.plans.fixtures import DIM, IS_QUERY, SPACES, new, old, search_sql, shear
from vektrail.session import table


def _long(rows, digits: int = 6):
    return rows.select("id", F.posexplode("v").alias("i", "x")).select("id", "i", F.round("x", digits).alias("x"))


def _long_sql(expr: str, source: str = "old") -> str:
    return f"WITH {SPACES}, m AS (SELECT id, {expr} AS v FROM {source}) SELECT id, unnest(range(len(v))) AS i, round(unnest(v), 6) AS x FROM m"


def vec_dot(s, d):
    pair = old(s, d).join(new(s, d).select("id", F.col("v").alias("w")), "id")
    return pair.select("id", F.round(vec.dot(F.col("v"), F.col("w")), 6).alias("dot"), F.round(vec.norm(F.col("w")), 6).alias("norm"))


def vec_normalize(s, d):
    zero = old(s, d).withColumn("v", F.when(F.col("id") % 7 == 0, F.transform("v", lambda x: x * 0)).otherwise(F.transform("v", lambda x: x * 3)))
    return _long(zero.withColumn("v", vec.l2_normalize(F.col("v"))))


def vec_pad(s, d):
    return _long(old(s, d).withColumn("v", vec.pad_or_truncate(F.col("v"), 80)))


def vec_truncate(s, d):
    return _long(old(s, d).withColumn("v", vec.truncate(F.col("v"), 16)))


def vec_quant_int8(s, d):
    return _long(old(s, d).withColumn("v", vec.quantize_int8(F.col("v"))))


def vec_quant_binary(s, d):
    return _long(old(s, d).withColumn("v", vec.quantize_binary(F.col("v"))))


def vec_quant_float16(s, d):
    return _long(old(s, d).withColumn("v", vec.quantize(F.col("v"), "float16")))


def vec_literal(s, d):
    return old(s, d).select("id", vec.literal(F.slice("v", 1, 4), 4).alias("text"), F.round(F.get(vec.from_literal(vec.literal(F.col("v"))), F.lit(3)), 6).alias("fourth"))


def vec_blob(s, d):
    both = old(s, d).withColumn("w", vec.from_blob(vec.to_blob(F.col("v").cast("array<float>"))))
    return both.select("id", F.size("w").alias("dim"), F.round(F.get("w", F.lit(0)).cast("double"), 6).alias("first"))


def vec_dimension(s, d):
    return old(s, d).agg(F.count("*").alias("rows"), F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most"))


def scan_projection(s, d):
    wanted = table(s, d, "reading_labels").select(F.col("doc_id").alias("id")).distinct()
    return knn.require_known(wanted, table(s, d, "documents").select(F.col("doc_id").alias("id"), "lang", "n_chars")).select("id", "lang", "n_chars")


def join_missing_ids(s, d):
    return table(s, d, "documents").select(F.col("doc_id").alias("id")).join(old(s, d).select("id"), "id", "left_anti")


def _search(queries, docs, k, **kw):
    return knn.top_k(queries, docs, k, **kw).withColumn("score", F.round("score", 6))


def knn_exact_top10(s, d):
    return _search(old(s, d).where(IS_QUERY), old(s, d), 10)


def knn_self_masked(s, d):
    return _search(new(s, d).where(IS_QUERY), new(s, d), 10, self_mask=True)


def knn_biased(s, d):
    docs = old(s, d).withColumn("b", (F.col("id") % 7) / 50.0)
    return _search(old(s, d).where(IS_QUERY), docs, 10, bias="b")


def knn_rescored(s, d):
    coarse = old(s, d).withColumn("v", vec.quantize_int8(vec.truncate(F.col("v"), 32)))
    found = knn.top_k(coarse.where(IS_QUERY), coarse, 50)
    return knn.rescored(found, old(s, d), old(s, d), 10).withColumn("score", F.round("score", 6))


def knn_matched_mean(s, d):
    found = knn.top_k(new(s, d).where(F.col("id") % 20 == 0), old(s, d), 5)
    return knn.matched_mean(found, old(s, d), DIM).select(F.col("query_id").alias("id"), "v").transform(_long)


def knn_store_search(s, d):
    query = [(-1.0) ** i * (i + 1) / 64 for i in range(DIM)]
    return knn.search_one(old(s, d), query, 20, where=F.col("label") == 3).withColumn("score", F.round("score", 6))


def knn_shear_top10(s, d):
    return _search(shear(s, d).where(IS_QUERY), old(s, d), 10)


QUERIES = {f.__name__: f for f in (vec_dot, vec_normalize, vec_pad, vec_truncate, vec_quant_int8, vec_quant_binary, vec_quant_float16, vec_literal, vec_blob, vec_dimension, scan_projection, join_missing_ids, knn_exact_top10, knn_self_masked, knn_biased, knn_rescored, knn_matched_mean, knn_store_search, knn_shear_top10)}

_TOP = "SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r"
_NORM = "greatest(sqrt(list_dot_product({0}, {0})), 1e-12)"
ORACLES = {
    "vec_dot": f"WITH {SPACES} SELECT o.id AS id, round(list_dot_product(o.v, n.v), 6) AS dot, round(sqrt(list_dot_product(n.v, n.v)), 6) AS norm FROM old o JOIN new n ON o.id = n.id",
    "vec_normalize": f"WITH {SPACES}, z AS (SELECT id, list_transform(v, lambda x: CASE WHEN id % 7 = 0 THEN 0.0 ELSE x * 3 END) AS v FROM old), m AS (SELECT id, list_transform(v, lambda x: x / {_NORM.format('v')}) AS v FROM z) SELECT id, unnest(range(len(v))) AS i, round(unnest(v), 6) AS x FROM m",
    "vec_pad": _long_sql("list_concat(v, list_transform(range(16), lambda x: 0.0::DOUBLE))"),
    "vec_truncate": _long_sql(f"list_transform(v[1:16], lambda x: x / {_NORM.format('v[1:16]')})"),
    "vec_quant_int8": _long_sql("list_transform(v, lambda x: round_even(x / list_max(list_transform(v, lambda y: abs(y))) * 127, 0) / 127 * list_max(list_transform(v, lambda y: abs(y))))"),
    "vec_quant_binary": _long_sql("list_transform(v, lambda x: CASE WHEN x >= 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END)"),
    "vec_literal": f"WITH {SPACES} SELECT id, '[' || array_to_string(list_transform(v[1:4], lambda x: printf('%.4f', x)), ',') || ']' AS text, round(v[4], 6) AS fourth FROM old",
    "vec_blob": f"WITH {SPACES} SELECT id, len(v) AS dim, round(v[1], 6) AS first FROM old",
    "vec_dimension": f"WITH {SPACES} SELECT count(*) AS rows, min(len(v)) AS least, max(len(v)) AS most FROM old",
    "scan_projection": "SELECT doc_id AS id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM reading_labels)",
    "join_missing_ids": "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "knn_exact_top10": f"WITH {SPACES}, {search_sql('r', '(SELECT * FROM old WHERE id % 5 = 0)', 'old', 10)} {_TOP}",
    "knn_self_masked": f"WITH {SPACES}, {search_sql('r', '(SELECT * FROM new WHERE id % 5 = 0)', 'new', 10, mask=True)} {_TOP}",
    "knn_biased": f"WITH {SPACES}, {search_sql('r', '(SELECT * FROM old WHERE id % 5 = 0)', 'old', 10, score='list_dot_product(q.v, d.v) + (d.id % 7) / 50.0')} {_TOP}",
    "knn_rescored": f"""WITH {SPACES}, t AS (SELECT id, list_transform(v[1:32], lambda x: x / {_NORM.format('v[1:32]')}) AS v FROM old),
c AS (SELECT id, list_transform(v, lambda x: round_even(x / list_max(list_transform(v, lambda y: abs(y))) * 127, 0) / 127 * list_max(list_transform(v, lambda y: abs(y)))) AS v FROM t),
{search_sql('f', '(SELECT * FROM c WHERE id % 5 = 0)', 'c', 50)},
{search_sql('r', '(SELECT * FROM old WHERE id % 5 = 0)', 'old', 10, where='(q.id, d.id) IN (SELECT (query_id, doc_id) FROM f)')} {_TOP}""",
    "knn_matched_mean": f"""WITH {SPACES}, {search_sql('f', '(SELECT * FROM new WHERE id % 20 = 0)', 'old', 5)},
p AS (SELECT f.query_id AS id, unnest(range(64)) AS i, unnest(d.v) AS x FROM f JOIN old d ON d.id = f.doc_id)
SELECT id, i, round(avg(x), 6) AS x FROM p GROUP BY id, i""",
    "knn_store_search": f"""WITH {SPACES}, q AS (SELECT list_transform(range(64), lambda i: (CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END) * (i + 1) / 64.0) AS v),
s AS (SELECT d.id AS id, round(list_dot_product(d.v, q.v) / ({_NORM.format('d.v')} * {_NORM.format('q.v')}), 9) AS score FROM old d, q WHERE d.label = 3)
SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM s ORDER BY score DESC, id LIMIT 20""",
    "knn_shear_top10": f"WITH {SPACES}, {search_sql('r', '(SELECT * FROM shear WHERE id % 5 = 0)', 'old', 10)} {_TOP}",
}
