"""Batch serving: fusion of ranked lists, mixed-space search and two-stage reranking.

The unit is a DataFrame of queries; hits are (query_id, id, score, rank from 0).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vektrail.functions import vec
from vektrail.operators.adapters import Adapter, Calibrator
from vektrail.operators.knn import DIGITS, top_k

RRF = 60  # fixed value: the constant of reciprocal rank fusion


def rerank(hits: DataFrame, *order) -> DataFrame:
    """Number the hits of each query anew from 0."""
    order = order or (F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)) - 1)


def rrf(*lists: DataFrame, constant: int = RRF) -> DataFrame:
    """Reciprocal rank fusion: sum of 1 / (constant + rank + 1), ties by id. Order of the lists does not matter."""
    rows = lists[0].select("query_id", "id", "rank")
    for other in lists[1:]:
        rows = rows.unionByName(other.select("query_id", "id", "rank"))
    fused = rows.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (constant + 1 + F.col("rank"))), 12).alias("score"))
    return rerank(fused)


def calibrated_merge(old: DataFrame, new: DataFrame, calibrator: Calibrator | None) -> DataFrame:
    """One list of two score scales: old scores pass through the calibrator, an id keeps its best score.

    At equal scores the old side's hit is kept. Order: score, then the place on its own
    side, then id. Without a calibrator this is reciprocal rank fusion.
    """
    if calibrator is None:
        return rrf(old, new)
    rows = old.select("query_id", "id", F.round(calibrator.column(F.col("score")), DIGITS).alias("score"), "rank", F.lit(0).alias("side"))
    rows = rows.unionByName(new.select("query_id", "id", "score", "rank", F.lit(1).alias("side")))
    best = W.partitionBy("query_id", "id").orderBy(F.desc("score"), "side", "rank")
    one = rows.withColumn("_b", F.row_number().over(best)).where("_b = 1").withColumnRenamed("rank", "own")
    return rerank(one, F.desc("score"), "own", "id").select("query_id", "id", "score", "rank")


def side_depth(k: int, done: int, total: int, new_side: bool) -> int:
    """How deep a side is searched so that about k hits survive: min(floor(k / share) + 1, 8 k)."""
    share = (done / total if new_side else 1 - done / total) if total else 0.0
    return k if share <= 0 else min(int(k / share) + 1, 8 * k)


def mixed_search(queries_old: DataFrame, queries_new: DataFrame, old: DataFrame, new: DataFrame, done: DataFrame, k: int, total: int, calibrator: Calibrator | None = None) -> DataFrame:
    """Search of a half-migrated index: migrated ids from the new space, the others from the old one.

    ``done`` has the migrated ids. A side nothing can come from is not searched.
    """
    n_done = done.count()
    parts = []
    if n_done < total:
        hits = top_k(queries_old, old, side_depth(k, n_done, total, False)).withColumnRenamed("doc_id", "id")
        parts.append(rerank(hits.join(done.select("id"), "id", "left_anti"), "rank"))
    if n_done > 0:
        hits = top_k(queries_new, new, side_depth(k, n_done, total, True)).withColumnRenamed("doc_id", "id")
        parts.append(rerank(hits.join(done.select("id"), "id", "left_semi"), "rank"))
    merged = parts[0] if len(parts) == 1 else calibrated_merge(parts[0], parts[1], calibrator)
    return merged.where(F.col("rank") < k).select("query_id", "id", "score", "rank")


def bridge(queries: DataFrame, adapter: Adapter, v: str = "v") -> DataFrame:
    """Queries of the new model as unit vectors of the index's space."""
    return queries.withColumn(v, adapter.udf(normalize=True)(F.col(v)))


def cascade(candidates: DataFrame, queries: DataFrame, fresh: DataFrame, k: int) -> DataFrame:
    """Candidates of the first stage reranked by the cosine of new vectors.

    A candidate without a new vector keeps its place; the others fill the free places
    in order of their new score, ties by first-stage place.
    """
    q = queries.select(F.col("id").alias("query_id"), F.col("v").alias("qv"))
    d = fresh.select("id", F.col("v").alias("dv"))
    rows = candidates.select("query_id", "id", F.col("score").alias("first"), "rank").join(q, "query_id").join(d, "id", "left")
    rows = rows.withColumn("new", F.round(vec.cosine(F.col("qv"), F.col("dv")), DIGITS))
    stranded = rows.where(F.col("new").isNull()).select("query_id", "id", F.col("first").alias("score"), F.col("rank").alias("place"))
    live = rows.where(F.col("new").isNotNull())
    slots = live.select("query_id", F.col("rank").alias("place"), F.row_number().over(W.partitionBy("query_id").orderBy("rank")).alias("i"))
    order = live.select("query_id", "id", F.col("new").alias("score"), F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("new"), "rank")).alias("i"))
    placed = order.join(slots, ["query_id", "i"]).select("query_id", "id", "score", "place")
    return placed.unionByName(stranded).withColumnRenamed("place", "rank").where(F.col("rank") < k)
