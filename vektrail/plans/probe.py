"""The whole measurement: fit candidates, evaluate each, choose one and recommend."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vektrail.operators import adapters, decision, groundtruth, knn, metrics
from vektrail.plans.fixtures import IS_QUERY, SPACES, grades, new, old, shear
from vektrail.plans.models import IS_FIT, pairs
from vektrail.session import staged


def run_probe(index: DataFrame, fresh: DataFrame, qrels: DataFrame, kinds: Sequence[str] = ("procrustes_centered", "linear", "low_rank_affine"), k: int = 10, depth: int = 50) -> DataFrame:
    """One row: the best map from ``fresh`` to ``index`` and what it keeps.

    Queries are rows of ``fresh`` with id % 5 = 0; maps are fitted on the others. Each
    candidate is searched plainly and with the CSLS bias, at the depth of the second
    stage once; CSLS is taken only if it keeps strictly more. The driver holds one
    moment row and one number per candidate.
    """
    spark = index.sparkSession
    both = pairs(fresh, index)
    fitted = adapters.fit_candidates(adapters.Moments.of(both.where(IS_FIT)), list(kinds))
    queries = fresh.where(IS_QUERY)
    oracle = staged(groundtruth.tier0(fresh, IS_QUERY, depth), "oracle")
    truth = groundtruth.sparse(oracle)
    own = metrics.mean_of(metrics.recall_per_query(oracle, truth, k), "recall").first()[0]
    csls_sample = staged(fresh.where(IS_FIT).orderBy(F.xxhash64("id"), "id").limit(4_000).withColumn("v", fitted[0].udf(normalize=True)(F.col("v"))), "csls")
    bias = adapters.csls_bias(index, csls_sample)
    rows = []
    rankings = {}
    for a in fitted:
        mapped = staged(queries.withColumn("v", a.udf(normalize=True)(F.col("v"))), "mapped")
        plain = staged(knn.top_k(mapped, index, max(k, depth), self_mask=True), "plain")
        hub = staged(knn.top_k(mapped, index.join(bias, "id", "left").fillna(0.0, ["bias"]), max(k, depth), bias="bias", self_mask=True), "csls")
        keep = [metrics.mean_of(metrics.recall_per_query(r, truth, k), "recall").first()[0] / own for r in (plain, hub)]
        rankings[a.kind] = hub if keep[1] > keep[0] else plain
        rows.append((a.kind, float(max(keep)), a.n_params, keep[1] > keep[0]))
    table_ = spark.createDataFrame(rows, "name string, score double, n_params int, csls boolean")
    best = adapters.select_best(table_).first()
    ranked = rankings[best.name]
    recall_old = metrics.mean_of(metrics.recall_per_query(knn.top_k(index.where(IS_QUERY), index, k, self_mask=True), qrels, k), "recall").first()[0]
    recall_new = metrics.mean_of(metrics.recall_per_query(oracle, qrels, k), "recall").first()[0]
    interval = metrics.bootstrap(metrics.recall_per_query(ranked, truth, k), "recall").first()
    clusters = index.select(F.col("id").alias("query_id"), F.col("label").alias("cluster")) if "label" in index.columns else None
    tail = metrics.tail_recall(metrics.recall_per_query(ranked, truth, k), clusters).first()[0] if clusters is not None else None
    two = metrics.mean_of(metrics.recall_per_query(knn.rescored(ranked, fresh, fresh, k), truth, k), "recall").first()[0] / own
    measured = spark.createDataFrame(
        [(best.name, best.csls, float(best.score), interval.low, interval.high, float(recall_new / recall_old) if recall_old else None, float(metrics.ks_distance(ranked, oracle).first()[0]), tail, None, "t0", False, None, float(two), float(metrics.candidate_reuse(ranked, depth).first()[0]), depth, True)],
        "name string, csls boolean, arr double, ci_low double, ci_high double, gain double, shift double, tail double, old_arr double, tier string, uninformative boolean, ndcg_gain double, cascade_arr double, reuse double, rows int, can_read_text boolean",
    )
    return decision.decided(measured)


def probe_shear(s, d):
    return run_probe(old(s, d), shear(s, d), grades(s, d))


def probe_rotation(s, d):
    """An exact rotation: everything is kept and there is nothing to gain."""
    return run_probe(old(s, d), new(s, d), grades(s, d), kinds=("procrustes_centered",)).select("name", F.round("arr", 6).alias("arr"), F.round("gain", 6).alias("gain"), "decision")


def _inputs(s, d):
    """A grid of measured numbers, made from ids."""
    i = F.col("id")
    part = lambda step, base, scale: (F.pmod(F.floor(i / step), F.lit(7)) * scale + base).cast("double")
    rows = old(s, d).select("id", F.round(part(1, 0.66, 0.05), 4).alias("arr"), F.when(i % 13 == 0, F.lit(None)).otherwise(F.round(part(7, 0.98, 0.03), 4)).alias("gain"), F.when(i % 5 == 0, F.round(part(3, 0.7, 0.05), 4)).alias("old_arr"))
    return rows.select("*", (F.col("arr") - 0.02).alias("ci_low"), (F.col("arr") + 0.02).alias("ci_high"), F.lit(0.05).alias("shift"), F.lit(None).cast("double").alias("tail"), F.lit("t1").alias("tier"), F.lit(False).alias("uninformative"), F.lit(None).cast("double").alias("ndcg_gain"), (F.col("arr") + 0.1).alias("cascade_arr"), F.lit(0.5).alias("reuse"), F.lit(200).alias("rows"), F.lit(True).alias("can_read_text"))


def dec_grid(s, d):
    return decision.decided(_inputs(s, d)).select("id", "decision", "provisional", "arrangement")


def dec_survivors(s, d):
    return decision.survivors(_inputs(s, d)).select("id", "gain")


QUERIES = {f.__name__: f for f in (probe_shear, probe_rotation, dec_grid, dec_survivors)}

_IN = """i AS (SELECT vec_id AS id, round((vec_id % 7) * 0.05::DOUBLE + 0.66::DOUBLE, 4) AS arr,
  CASE WHEN vec_id % 13 <> 0 THEN round((floor(vec_id / 7) % 7) * 0.03::DOUBLE + 0.98::DOUBLE, 4) END AS gain,
  CASE WHEN vec_id % 5 = 0 THEN round((floor(vec_id / 3) % 7) * 0.05::DOUBLE + 0.7::DOUBLE, 4) END AS old_arr FROM embeddings)"""
ORACLES = {
    "probe_rotation": "SELECT 'procrustes_centered' AS name, 1.0::DOUBLE AS arr, 1.0::DOUBLE AS gain, 'no_upgrade_needed' AS decision",
    "dec_grid": f"""WITH {_IN}, f AS (SELECT *, coalesce(gain < 1.02, FALSE) AS flat, coalesce(old_arr - arr > 0.025, FALSE) AS loses, arr * gain AS adv FROM i)
SELECT id, CASE WHEN flat THEN 'no_upgrade_needed' WHEN loses THEN CASE WHEN gain >= 1.02 THEN 'full_reindex' ELSE 'no_upgrade_needed' END
  WHEN adv > 1.025 THEN CASE WHEN arr >= 0.95 THEN 'bridge_sufficient' ELSE 'bridge_and_migrate' END
  WHEN arr >= 0.95 THEN 'bridge_sufficient' WHEN arr >= 0.85 THEN 'bridge_and_migrate' WHEN arr >= 0.7 THEN 'caution' ELSE 'full_reindex' END AS decision,
  gain IS NULL OR (NOT flat AND NOT loses AND abs(adv - 1) <= 0.025) AS provisional,
  CASE WHEN (arr + 0.1) * gain > 1.025 AND NOT (adv > 1.025) THEN 'cascade' ELSE 'single_stage' END AS arrangement FROM f""",
    "dec_survivors": f"WITH {_IN} SELECT id, gain FROM i WHERE gain >= (SELECT max(gain) FROM i) - 0.025",
}
