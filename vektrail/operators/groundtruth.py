"""Ground truth: what a query should find, from weakest (0) to synthesised (2) evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vektrail.operators.knn import top_k
from vektrail.operators.metrics import cut


def tier0(new: DataFrame, is_query, k: int) -> DataFrame:
    """Held-out documents as queries: the new space's k nearest documents, never the query itself."""
    return top_k(new.where(is_query), new, k, self_mask=True)


def sparse(oracle: DataFrame) -> DataFrame:
    """Only the nearest neighbour counts as relevant."""
    return cut(oracle, 1).select("query_id", "doc_id", F.lit(1).alias("grade"))


def tier1(queries: DataFrame, qrels: DataFrame, sample: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Judged real queries: (queries, qrels) that have a relevant document in the sample."""
    kept = qrels.join(sample.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    return queries.join(kept.select(F.col("query_id").alias("id")).distinct(), "id", "left_semi"), kept


def tier1_unjudged(queries: DataFrame, new: DataFrame, k: int) -> DataFrame:
    """Real queries without judgements: the new space's own top k is the truth."""
    return top_k(queries, new, k)


def tier2(synthetic: DataFrame, new: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Synthesised queries: the source document is the answer and is not masked.

    Returns the oracle ranking and the judgements (query_id, doc_id, grade).
    """
    return top_k(synthetic, new, k), synthetic.select(F.col("id").alias("query_id"), F.col("source_id").alias("doc_id"), F.lit(1).alias("grade"))


def query_clusters(qrels: DataFrame, clusters: DataFrame) -> DataFrame:
    """(query_id, cluster): the cluster of each query's smallest relevant document."""
    first = qrels.groupBy("query_id").agg(F.min("doc_id").alias("doc_id"))
    return first.join(clusters.select(F.col("id").alias("doc_id"), "cluster"), "doc_id").select("query_id", "cluster")
