"""Queries of retrieval metrics and ground truth.

The measured ranking searches the old index with sheared queries; the truth is the
rotated space's own ranking.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vektrail.operators import groundtruth, knn, metrics
from vektrail.plans.fixtures import GRADES, IS_QUERY, SPACES, grades, new, old, search_sql, shear

K = 10


def _ranked(s, d, k=K):
    return knn.top_k(shear(s, d).where(IS_QUERY), old(s, d), k, self_mask=True)


def _oracle(s, d, k=K):
    return groundtruth.tier0(new(s, d), IS_QUERY, k)


def _round(rows, col):
    return rows.withColumn(col, F.round(col, 6))


def gt_tier0(s, d):
    return _round(_oracle(s, d), "score")


def gt_tier0_sparse(s, d):
    return groundtruth.sparse(_oracle(s, d))


def gt_tier1(s, d):
    queries, kept = groundtruth.tier1(old(s, d).where(IS_QUERY), grades(s, d), old(s, d).where("id % 3 <> 0"))
    return kept.join(queries.select(F.col("id").alias("query_id")), "query_id", "left_semi").groupBy("query_id").agg(F.count("*").alias("relevant"), F.sum("grade").alias("grades"))


def gt_tier1_unjudged(s, d):
    return _round(groundtruth.tier1_unjudged(shear(s, d).where("id % 10 = 1"), new(s, d), 5), "score")


def gt_tier2(s, d):
    made = new(s, d).where("id % 10 = 3").select((F.col("id") + 1_000_000).alias("id"), "v", F.col("id").alias("source_id"))
    ranked, judged = groundtruth.tier2(made, new(s, d), 3)
    return ranked.join(judged, ["query_id", "doc_id"], "left").select("query_id", "doc_id", "rank", F.coalesce("grade", F.lit(0)).alias("grade"))


def gt_query_clusters(s, d):
    return groundtruth.query_clusters(groundtruth.sparse(_oracle(s, d)), old(s, d).select("id", F.col("label").alias("cluster")))


def met_recall(s, d):
    return _round(metrics.recall_per_query(_ranked(s, d), _oracle(s, d).select("query_id", "doc_id"), K), "recall")


def met_recall_mean(s, d):
    return _round(metrics.mean_of(metrics.recall_per_query(_ranked(s, d), _oracle(s, d).select("query_id", "doc_id"), K), "recall"), "recall")


def met_mrr(s, d):
    return _round(metrics.mrr(_ranked(s, d), grades(s, d), K), "rr")


def met_ndcg_binary(s, d):
    return _round(metrics.ndcg_per_query(_ranked(s, d), _oracle(s, d).select("query_id", "doc_id"), K), "ndcg")


def met_ndcg_graded(s, d):
    return _round(metrics.ndcg_per_query(_ranked(s, d), grades(s, d), K), "ndcg")


def met_overlap(s, d):
    return metrics.overlap_per_query(_ranked(s, d), _oracle(s, d), K)


def met_spearman(s, d):
    return _round(metrics.spearman_per_query(_oracle(s, d), _ranked(s, d), K), "rho")


def met_ks(s, d):
    return _round(metrics.ks_distance(_ranked(s, d), _oracle(s, d)), "ks")


def met_reuse(s, d):
    return _round(metrics.candidate_reuse(_ranked(s, d), K), "reuse")


def met_tail(s, d):
    recall = metrics.recall_per_query(_ranked(s, d), _oracle(s, d).select("query_id", "doc_id"), K)
    return _round(metrics.tail_recall(recall, old(s, d).select(F.col("id").alias("query_id"), F.col("label").alias("cluster")), fraction=0.25), "tail")


def met_arr(s, d):
    """Recall of the nearest true neighbour, relative to the oracle's own."""
    truth = groundtruth.sparse(_oracle(s, d))
    got = metrics.mean_of(metrics.recall_per_query(_ranked(s, d), truth, K), "recall")
    best = metrics.mean_of(metrics.recall_per_query(_oracle(s, d), truth, K), "recall").withColumnRenamed("recall", "best")
    return got.crossJoin(best).select(F.round(F.col("recall") / F.col("best"), 6).alias("arr"))  # two single rows


def met_upgrade_gain(s, d):
    """Recall of judged documents in the new space over that in the old one."""
    a = metrics.mean_of(metrics.recall_per_query(knn.top_k(shear(s, d).where(IS_QUERY), shear(s, d), K, self_mask=True), grades(s, d), K), "recall")
    b = metrics.mean_of(metrics.recall_per_query(knn.top_k(old(s, d).where(IS_QUERY), old(s, d), K, self_mask=True), grades(s, d), K), "recall")
    return a.crossJoin(b.withColumnRenamed("recall", "base")).select(F.round(F.col("recall") / F.col("base"), 6).alias("gain"))  # two single rows


def met_bootstrap_mean(s, d):
    recall = metrics.recall_per_query(_ranked(s, d), _oracle(s, d).select("query_id", "doc_id"), K)
    got = metrics.bootstrap(recall, "recall", seed=3)
    return got.select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def met_bootstrap_ratio(s, d):
    both = metrics.ndcg_per_query(_ranked(s, d), grades(s, d), K).join(metrics.ndcg_per_query(knn.top_k(old(s, d).where(IS_QUERY), old(s, d), K, self_mask=True), grades(s, d), K).withColumnRenamed("ndcg", "base"), "query_id")
    got = metrics.bootstrap(both, "ndcg", seed=5, denominator="base")
    return got.select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def met_ceiling(s, d):
    """Recall when each query is the mean of its relevant vectors: the most any map could reach."""
    rel = _oracle(s, d, 3).select("query_id", "doc_id")
    best = knn.matched_mean(rel, old(s, d), 64).select(F.col("query_id").alias("id"), "v")
    return _round(metrics.recall_per_query(knn.top_k(best, old(s, d), K), rel, K), "recall")


QUERIES = {f.__name__: f for f in (gt_tier0, gt_tier0_sparse, gt_tier1, gt_tier1_unjudged, gt_tier2, gt_query_clusters, met_recall, met_recall_mean, met_mrr, met_ndcg_binary, met_ndcg_graded, met_overlap, met_spearman, met_ks, met_reuse, met_tail, met_arr, met_upgrade_gain, met_bootstrap_mean, met_bootstrap_ratio, met_ceiling)}

_R = search_sql("r", "(SELECT * FROM shear WHERE id % 5 = 0)", "old", K, mask=True)
_O = search_sql("o", "(SELECT * FROM new WHERE id % 5 = 0)", "new", K, mask=True)
_BOTH = f"WITH {SPACES}, {_R}, {_O}, {GRADES}"
_RECALL = "recall AS (SELECT o.query_id, count(r.doc_id) / count(*) AS recall FROM o LEFT JOIN r ON r.query_id = o.query_id AND r.doc_id = o.doc_id GROUP BY o.query_id)"


def _ndcg(name: str, ranked: str, judged: str) -> str:
    return f"""
{name}_i AS (SELECT query_id, sum(grade / log2(rn + 1)) AS ideal FROM (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS rn FROM {judged}) WHERE rn <= {K} GROUP BY query_id),
{name}_d AS (SELECT r.query_id, sum(j.grade / log2(r.rank + 2)) AS dcg FROM {ranked} r JOIN {judged} j ON j.query_id = r.query_id AND j.doc_id = r.doc_id GROUP BY r.query_id),
{name} AS (SELECT i.query_id, coalesce(d.dcg, 0) / i.ideal AS ndcg FROM {name}_i i LEFT JOIN {name}_d d ON d.query_id = i.query_id)"""


def _boot(rows: str, value: str, draws: int, seed: int) -> str:
    return f"""
numbered AS (SELECT *, row_number() OVER (ORDER BY query_id) - 1 AS pos FROM {rows}),
picks AS (SELECT b, ('0x' || substr(md5('{seed}|' || b || '|' || i), 1, 8))::BIGINT % (SELECT count(*) FROM numbered) AS pos
  FROM range({draws}) t(b), range((SELECT count(*) FROM numbered)) u(i)),
means AS (SELECT b, {value} AS m FROM picks JOIN numbered USING (pos) GROUP BY b)
SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM means"""


_MEAN = "SELECT o.query_id, avg({0}) FROM o"
ORACLES = {
    "gt_tier0": f"{_BOTH} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM o",
    "gt_tier0_sparse": f"{_BOTH} SELECT query_id, doc_id, 1 AS grade FROM o WHERE rank = 0",
    "gt_tier1": f"{_BOTH} SELECT query_id, count(*) AS relevant, sum(grade)::BIGINT AS grades FROM qrels WHERE doc_id % 3 <> 0 GROUP BY query_id",
    "gt_tier1_unjudged": f"WITH {SPACES}, {search_sql('r', '(SELECT * FROM shear WHERE id % 10 = 1)', 'new', 5)} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r",
    "gt_tier2": f"WITH {SPACES}, {search_sql('r', '(SELECT id + 1000000 AS id, v FROM new WHERE id % 10 = 3)', 'new', 3)} SELECT query_id, doc_id, rank, CASE WHEN query_id = doc_id + 1000000 THEN 1 ELSE 0 END AS grade FROM r",
    "gt_query_clusters": f"{_BOTH} SELECT o.query_id AS query_id, d.label AS cluster FROM o JOIN old d ON d.id = o.doc_id WHERE o.rank = 0",
    "met_recall": f"{_BOTH}, {_RECALL} SELECT query_id, round(recall, 6) AS recall FROM recall",
    "met_recall_mean": f"{_BOTH}, {_RECALL} SELECT round(avg(recall), 6) AS recall FROM recall",
    "met_mrr": f"{_BOTH} SELECT j.query_id AS query_id, round(coalesce(max(1.0 / (r.rank + 1)), 0), 6) AS rr FROM qrels j LEFT JOIN r ON r.query_id = j.query_id AND r.doc_id = j.doc_id GROUP BY j.query_id",
    "met_ndcg_binary": f"{_BOTH}, b AS (SELECT query_id, doc_id, 1 AS grade FROM o), {_ndcg('n', 'r', 'b')} SELECT query_id, round(ndcg, 6) AS ndcg FROM n",
    "met_ndcg_graded": f"{_BOTH}, {_ndcg('n', 'r', 'qrels')} SELECT query_id, round(ndcg, 6) AS ndcg FROM n",
    "met_overlap": f"{_BOTH} SELECT r.query_id AS query_id, count(o.doc_id) / {K} AS overlap FROM r LEFT JOIN o ON o.query_id = r.query_id AND o.doc_id = r.doc_id GROUP BY r.query_id",
    "met_spearman": f"""{_BOTH}, p AS (SELECT o.query_id, o.rank AS t, coalesce(r.rank, {K}) AS f FROM o LEFT JOIN r ON r.query_id = o.query_id AND r.doc_id = o.doc_id),
m AS (SELECT query_id, t, f, rank() OVER (PARTITION BY query_id ORDER BY t) + (count(*) OVER (PARTITION BY query_id, t) - 1) / 2 AS x,
  rank() OVER (PARTITION BY query_id ORDER BY f) + (count(*) OVER (PARTITION BY query_id, f) - 1) / 2 AS y FROM p)
SELECT query_id, round(corr(x, y), 6) AS rho FROM m GROUP BY query_id HAVING count(DISTINCT f) > 1 AND count(DISTINCT t) > 1""",
    "met_ks": f"""{_BOTH}, u AS (SELECT score AS s, 1 AS x, 0 AS y FROM r UNION ALL SELECT score, 0, 1 FROM o),
c AS (SELECT s, sum(sum(x)) OVER (ORDER BY s) AS cx, sum(sum(y)) OVER (ORDER BY s) AS cy FROM u GROUP BY s)
SELECT round(max(abs(cx / (SELECT count(*) FROM r) - cy / (SELECT count(*) FROM o))), 6) AS ks FROM c""",
    "met_reuse": f"{_BOTH} SELECT round(1 - count(DISTINCT doc_id) / count(*), 6) AS reuse FROM r",
    "met_tail": f"""{_BOTH}, {_RECALL}, c AS (SELECT r.query_id, r.recall, d.label FROM recall r JOIN old d ON d.id = r.query_id),
z AS (SELECT label, count(*) AS size, row_number() OVER (ORDER BY count(*), label) AS rn, count(*) OVER () AS n FROM c GROUP BY label)
SELECT round(avg(recall), 6) AS tail FROM c WHERE label IN (SELECT label FROM z WHERE rn <= greatest(1, round_even(n * 0.25, 0)))""",
    "met_arr": f"{_BOTH} SELECT round(avg(CASE WHEN r.doc_id IS NULL THEN 0 ELSE 1 END), 6) AS arr FROM o LEFT JOIN r ON r.query_id = o.query_id AND r.doc_id = o.doc_id WHERE o.rank = 0",
    "met_upgrade_gain": f"""{_BOTH}, {search_sql('a', '(SELECT * FROM shear WHERE id % 5 = 0)', 'shear', K, mask=True)}, {search_sql('b', '(SELECT * FROM old WHERE id % 5 = 0)', 'old', K, mask=True)},
ra AS (SELECT j.query_id, count(a.doc_id) / count(*) AS x FROM qrels j LEFT JOIN a ON a.query_id = j.query_id AND a.doc_id = j.doc_id GROUP BY j.query_id),
rb AS (SELECT j.query_id, count(b.doc_id) / count(*) AS x FROM qrels j LEFT JOIN b ON b.query_id = j.query_id AND b.doc_id = j.doc_id GROUP BY j.query_id)
SELECT round((SELECT avg(x) FROM ra) / (SELECT avg(x) FROM rb), 6) AS gain""",
    "met_bootstrap_mean": f"{_BOTH}, {_RECALL}, {_boot('recall', 'avg(recall)', 2000, 3)}",
    "met_bootstrap_ratio": f"""{_BOTH}, {search_sql('b', '(SELECT * FROM old WHERE id % 5 = 0)', 'old', K, mask=True)}, {_ndcg('n', 'r', 'qrels')}, {_ndcg('e', 'b', 'qrels')},
two AS (SELECT n.query_id, n.ndcg AS ndcg, e.ndcg AS base FROM n JOIN e ON e.query_id = n.query_id), {_boot('two', 'avg(ndcg) / nullif(avg(base), 0)', 2000, 5)}""",
    "met_ceiling": f"""{_BOTH}, rel AS (SELECT query_id, doc_id FROM o WHERE rank < 3),
p AS (SELECT rel.query_id AS id, unnest(range(64)) AS i, unnest(d.v) AS x FROM rel JOIN old d ON d.id = rel.doc_id),
a AS (SELECT id, i, avg(x) AS x FROM p GROUP BY id, i), c AS (SELECT id, list(x ORDER BY i) AS v FROM a GROUP BY id),
{search_sql('f', 'c', 'old', K)}
SELECT rel.query_id AS query_id, round(count(f.doc_id) / count(*), 6) AS recall FROM rel LEFT JOIN f ON f.query_id = rel.query_id AND f.doc_id = rel.doc_id GROUP BY rel.query_id""",
}
