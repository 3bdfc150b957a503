"""Retrieval metrics over ranked lists and relevance judgements.

``ranked`` has (query_id, doc_id, rank from 0, score); ``qrels`` has (query_id,
doc_id, grade). Queries without a relevant document take no part. A mean over no
query is NaN, save nDCG, which is 0; "not measurable" is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NAN = float("nan")
DRAWS = 2_000


def cut(ranked: DataFrame, k: int) -> DataFrame:
    return ranked.where(F.col("rank") < k)


def _judged(qrels: DataFrame) -> DataFrame:
    grade = F.col("grade") if "grade" in qrels.columns else F.lit(1)
    return qrels.groupBy("query_id", "doc_id").agg(F.max(grade).alias("grade")).where("grade > 0")


def recall_per_query(ranked: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): share of the relevant documents among the first k."""
    hit = cut(ranked, k).select("query_id", "doc_id").distinct().withColumn("hit", F.lit(1))
    return _judged(qrels).join(hit, ["query_id", "doc_id"], "left").groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))


def mean_of(per_query: DataFrame, col: str, empty: float = NAN) -> DataFrame:
    return per_query.agg(F.coalesce(F.avg(col), F.lit(empty)).alias(col))


def mrr(ranked: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """(query_id, rr): reciprocal of the first relevant place within k, else 0."""
    judged = _judged(qrels)
    first = cut(ranked, k).join(judged, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first"))
    return judged.select("query_id").distinct().join(first, "query_id", "left").select("query_id", F.coalesce(1.0 / (F.col("first") + 1), F.lit(0.0)).alias("rr"))


def ndcg_per_query(ranked: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """(query_id, ndcg) with linear gains; the ideal list is the k highest grades of the query."""
    judged = _judged(qrels)
    gain = F.sum(F.col("grade") / F.log2(F.col("rank") + 2))
    dcg = cut(ranked, k).join(judged, ["query_id", "doc_id"]).groupBy("query_id").agg(gain.alias("dcg"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id")) - 1
    ideal = judged.withColumn("rank", place).where(F.col("rank") < k).groupBy("query_id").agg(gain.alias("ideal"))
    return ideal.join(dcg, "query_id", "left").select("query_id", (F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).alias("ndcg"))


def overlap_per_query(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(query_id, overlap): common documents of the first k of two rankings, divided by k."""
    left, right = cut(a, k).select("query_id", "doc_id").distinct(), cut(b, k).select("query_id", "doc_id").distinct()
    both = left.join(right, ["query_id", "doc_id"]).groupBy("query_id").agg(F.count("*").alias("c"))
    return left.select("query_id").distinct().join(both, "query_id", "left").select("query_id", (F.coalesce("c", F.lit(0)) / k).alias("overlap"))


def spearman_per_query(truth: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """(query_id, rho): correlation of the true places with the found ones.

    A true document that was not found has place k. Queries whose found places are
    not at least two different ones are left out.
    """
    found = cut(ranked, k).select("query_id", "doc_id", F.col("rank").alias("found"))
    pairs = cut(truth, k).join(found, ["query_id", "doc_id"], "left").withColumn("found", F.coalesce("found", F.lit(k)))

    def mid_rank(col: str) -> Column:
        ties = W.partitionBy("query_id", col)
        return F.rank().over(W.partitionBy("query_id").orderBy(col)) + (F.count("*").over(ties) - 1) / 2

    ranks = pairs.withColumn("x", mid_rank("rank")).withColumn("y", mid_rank("found"))
    got = ranks.groupBy("query_id").agg(F.corr("x", "y").alias("rho"), F.countDistinct("found").alias("d"), F.countDistinct("rank").alias("t"))
    return got.where("d > 1 AND t > 1").select("query_id", "rho")


def ks_distance(a: DataFrame, b: DataFrame, score: str = "score") -> DataFrame:
    """(ks): largest gap of two empirical distributions.

    Counts are first combined per score; running counts need one ordered pass, over
    distinct scores only.
    """
    both = a.select(F.col(score).alias("s"), F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(F.col(score).alias("s"), F.lit(0).alias("x"), F.lit(1).alias("y")))
    steps = both.where(F.col("s").isNotNull()).groupBy("s").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    w = W.orderBy("s").rowsBetween(W.unboundedPreceding, 0)
    run = steps.select(F.sum("x").over(w).alias("cx"), F.sum("y").over(w).alias("cy"))
    ends = steps.agg(F.sum("x").alias("nx"), F.sum("y").alias("ny"))
    return run.crossJoin(F.broadcast(ends)).agg(F.max(F.abs(F.col("cx") / F.col("nx") - F.col("cy") / F.col("ny"))).alias("ks"))  # ends is one row


def candidate_reuse(ranked: DataFrame, depth: int, approximate: bool = False) -> DataFrame:
    """(reuse): 1 - distinct documents / retrieved documents within ``depth``."""
    distinct = F.approx_count_distinct("doc_id", 0.01) if approximate else F.countDistinct("doc_id")
    return cut(ranked, depth).agg((1 - distinct / F.count("*")).alias("reuse"))


def hashed_draw(seed: int, draw: Column, i: Column, n: Column) -> Column:
    """A reproducible index in [0, n): 32 bits of an MD5, as any SQL engine can compute it."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), draw, i)), 1, 8), 16, 10).cast("long") % n


def bootstrap(per_query: DataFrame, value: str, draws: int = DRAWS, seed: int = 0, denominator: str | None = None, level: float = 0.95) -> DataFrame:
    """(low, high): percentile interval of a mean, or of a ratio of two means on the same draws.

    Rows are numbered in order of query_id; draw b takes row hash(seed|b|i) for each i.
    Draws with a zero denominator are dropped. No rows give nulls.
    """
    rows = per_query.where(F.col(value).isNotNull()).select("query_id", F.col(value).alias("num"), (F.col(denominator) if denominator else F.lit(1.0)).alias("den"))
    rows = rows.withColumn("at", F.row_number().over(W.orderBy("query_id")) - 1)  # one row per query of the evaluation set
    n = rows.count()
    if not n:
        return per_query.sparkSession.sql("SELECT CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high")
    grid = per_query.sparkSession.range(draws).select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    picked = grid.withColumn("at", hashed_draw(seed, F.col("b"), F.col("i"), F.lit(n))).join(rows, "at")
    means = picked.groupBy("b").agg((F.avg("num") / F.when(F.avg("den") != 0, F.avg("den"))).alias("m")).where(F.col("m").isNotNull())
    tail = (1 - level) / 2
    return means.agg(F.percentile("m", tail).alias("low"), F.percentile("m", 1 - tail).alias("high"))


def tail_recall(per_query: DataFrame, clusters: DataFrame, fraction: float = 0.1, least_clusters: int = 4, least_queries: int = 30) -> DataFrame:
    """(tail): mean recall over the queries of the smallest clusters, sized by queries.

    Null with fewer than ``least_clusters`` clusters or ``least_queries`` queries. The
    number of clusters is ``fraction`` of them, half-even, at least one.
    """
    rows = per_query.join(clusters.select("query_id", "cluster"), "query_id")
    sizes = rows.groupBy("cluster").agg(F.count("*").alias("size"))
    whole = W.partitionBy(F.lit(1))
    pick = sizes.withColumn("rn", F.row_number().over(W.orderBy("size", "cluster"))).withColumn("c", F.count("*").over(whole)).withColumn("q", F.sum("size").over(whole))
    pick = pick.where((F.col("rn") <= F.greatest(F.lit(1), F.bround(F.col("c") * fraction))) & (F.col("c") >= least_clusters) & (F.col("q") >= least_queries))
    return rows.join(pick.select("cluster"), "cluster", "left_semi").agg(F.avg("recall").alias("tail"))


def reindex_cost(rows: int, seconds_per_row: float, watts: float | None = None) -> tuple[float, float | None]:
    """(seconds, watt hours) of encoding all rows; energy only if the power is known."""
    seconds = round(max(0.0, rows * seconds_per_row), 1)
    return seconds, None if watts is None else seconds * watts / 3600
