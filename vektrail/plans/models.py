"""Queries of maps between spaces, and the flagship measurement."""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import functions as F

from vektrail.functions import vec
from vektrail.operators import adapters, exposure, groundtruth, knn, metrics
from vektrail.plans.fixtures import DIM, IS_QUERY, SPACES, new, old, search_sql, shear

IS_FIT = "id % 5 <> 0"


def pairs(source, target):
    """(id, src, dst): the vectors of two spaces, joined by id."""
    return source.select("id", F.col("v").alias("src")).join(target.select("id", F.col("v").alias("dst")), "id")


@cache
def rotation() -> adapters.Adapter:
    """The known map from ``new`` back to ``old``: x[63 - i] = (-1)^i y[i]."""
    w = np.zeros((DIM, DIM))
    for i in range(DIM):
        w[i, DIM - 1 - i] = (-1.0) ** i
    return adapters.Adapter("procrustes", w, np.zeros(DIM), DIM, DIM * DIM)


def flagship_bridge_recall(s, d):
    """(query_id, recall, ndcg, rr): what a bridge keeps of the new space's own ranking.

    A centred orthogonal map is fitted new -> old on four fifths; the other fifth is
    mapped and searched in the old index.
    """
    fitted = adapters.procrustes(adapters.Moments.of(pairs(new(s, d), old(s, d)).where(IS_FIT)))
    mapped = new(s, d).where(IS_QUERY).withColumn("v", adapters.Adapter.udf(fitted, normalize=True)(F.col("v")))
    found = knn.top_k(mapped, old(s, d), 10, self_mask=True)
    truth = groundtruth.tier0(new(s, d), IS_QUERY, 10).select("query_id", "doc_id")
    got = metrics.recall_per_query(found, truth, 10).join(metrics.ndcg_per_query(found, truth, 10), "query_id").join(metrics.mrr(found, truth, 10), "query_id")
    return got.select("query_id", *[F.round(c, 6).alias(c) for c in ("recall", "ndcg", "rr")])


def fit_apply_rotation(s, d):
    return new(s, d).withColumn("v", rotation().udf()(F.col("v"))).select("id", F.posexplode("v").alias("i", "x")).select("id", "i", F.round("x", 6).alias("x"))


def fit_geometry(s, d):
    delta, bound, _ = adapters.Moments.of(pairs(shear(s, d), old(s, d))).geometry()
    return s.createDataFrame([(round(delta, 6), round(bound, 5))], "delta double, bound double")


def fit_candidates(s, d):
    """(name, score, n_params): mean cosine of each fitted map on the held-out fifth."""
    both = pairs(shear(s, d), old(s, d))
    fitted = adapters.fit_candidates(adapters.Moments.of(both.where(IS_FIT)), ["identity", "procrustes", "procrustes_centered", "linear", "low_rank_affine", "linear+dsm", "procrustes_centered+dsm"])
    held = both.where(IS_QUERY)
    cols = [F.avg(vec.cosine(a.udf()(F.col("src")), F.col("dst"))).alias(f"c{i}") for i, a in enumerate(fitted)]
    row = held.agg(*cols).first()
    return s.createDataFrame([(a.kind, round(row[i], 6), a.n_params) for i, a in enumerate(fitted)], "name string, score double, n_params int")


def fit_select_best(s, d):
    return adapters.select_best(fit_candidates(s, d))


def fit_residual_mlp(s, d):
    both = pairs(shear(s, d), old(s, d))
    fit = both.where(IS_FIT)
    m = adapters.Moments.of(fit)
    got = adapters.residual_mlp(fit, m)
    return both.where(IS_QUERY).agg(F.round(F.avg(vec.cosine(got.udf()(F.col("src")), F.col("dst"))), 6).alias("cosine"))


def fit_csls_bias(s, d):
    return adapters.csls_bias(old(s, d), new(s, d).where("id % 3 = 0"), 10).withColumn("bias", F.round("bias", 6))


def fit_calibrator(s, d):
    found = knn.top_k(shear(s, d).where(IS_QUERY), old(s, d), 10).select("query_id", "rank", "score")
    truth = knn.top_k(old(s, d).where(IS_QUERY), old(s, d), 10).select("query_id", "rank", F.col("score").alias("target"))
    both = found.join(truth, ["query_id", "rank"])
    return both.select("query_id", "rank", F.round(adapters.Calibrator.fit(both).column(F.col("score")), 6).alias("score"))


def fit_refit_gain(s, d):
    both = pairs(shear(s, d), old(s, d))
    m = adapters.Moments.of(both.where(IS_FIT))
    return adapters.held_out_gain(both.where(IS_QUERY), adapters.procrustes(m), adapters.linear(m)).select(F.round("now", 6).alias("now"), F.round("new", 6).alias("new"))


def exp_identification(s, d):
    mapped = new(s, d).withColumn("v", rotation().udf()(F.col("v")))
    return exposure.identification(mapped.where(IS_QUERY), shear(s, d)).select("query_id", "place")


def exp_alignment(s, d):
    """Blind alignment of two unpaired samples and how often it finds a vector's own twin."""
    return exposure.measure(old(s, d), new(s, d))


QUERIES = {f.__name__: f for f in (flagship_bridge_recall, fit_apply_rotation, fit_geometry, fit_candidates, fit_select_best, fit_residual_mlp, fit_csls_bias, fit_calibrator, fit_refit_gain, exp_identification, exp_alignment)}

ORACLES = {
    "flagship_bridge_recall": f"WITH {SPACES} SELECT id AS query_id, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS ndcg, 1.0::DOUBLE AS rr FROM old WHERE id % 5 = 0",
    "fit_apply_rotation": f"WITH {SPACES} SELECT id, unnest(range(64)) AS i, round(unnest(v), 6) AS x FROM old",
    "fit_geometry": f"""WITH {SPACES}, p AS (SELECT list_dot_product(a.v, b.v) - list_dot_product(x.v, y.v) AS g
FROM shear a JOIN shear b ON a.id <> b.id JOIN old x ON x.id = a.id JOIN old y ON y.id = b.id)
SELECT round(sqrt(avg(g * g)), 6) AS delta, round(sqrt(128) * sqrt(avg(g * g)), 5) AS bound FROM p""",
    "fit_csls_bias": f"WITH {SPACES}, {search_sql('r', 'old', '(SELECT * FROM new WHERE id % 3 = 0)', 10)} SELECT query_id AS id, round(avg(score) * -0.5, 6) AS bias FROM r GROUP BY query_id",
    "exp_identification": f"""WITH {SPACES}, m AS (SELECT list_transform(range(1, 65), lambda i: (SELECT avg(v[i]) FROM shear)) AS c),
q AS (SELECT id, v FROM old WHERE id % 5 = 0),
s AS (SELECT q.id AS query_id, d.id AS doc_id, round(list_dot_product(q.v, d.v), 9) AS score FROM q, shear d)
SELECT a.query_id AS query_id, 1 + count(b.score) AS place FROM s a LEFT JOIN s b ON b.query_id = a.query_id AND b.score > a.score WHERE a.query_id = a.doc_id GROUP BY a.query_id""",
}
ORACLES["exp_identification"] = ORACLES["exp_identification"].replace("m AS (SELECT list_transform(range(1, 65), lambda i: (SELECT avg(v[i]) FROM shear)) AS c),\n", "")
