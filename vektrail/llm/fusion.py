"""One ranking from several differently scaled scores.

Method: the scores of each list (a query's hits from one side) are standardised by
their median and median absolute deviation, squashed by the logistic function, and
the bounded values of an item are combined by a weighted geometric mean over all
lists of its query. The mean is taken in logarithms, so that values far from the
median stay apart however close to 0 or 1 they are squashed.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vektrail.session import staged, table

ACCURACY = 200_000  # of the medians: exact up to this many rows of a list, else within 1 / ACCURACY of the rank; sketches are what lets a long list be spread over tasks
FARTHEST = 1e9  # deviations; scores farther out count as that far
CUTS = 32  # a query's items are placed in so many ranges
RANK_BUCKET = 4_096  # ranks of one list that one window holds
LIST = ["query_id", "side"]


def _finite(col: Column) -> Column:
    return F.when(~F.isnan(col) & (F.abs(col) != float("inf")), col)


def clean_hits(hits: DataFrame, sides: DataFrame) -> DataFrame:
    """One row (query_id, side, id, s, rank) per hit; s grows with quality, null if the score is missing.

    Repeated rows count once, by their best score and rank. A side that is not in ``sides`` counts as higher is
    better. Hits without query, side or id, or with neither score nor rank, are left out.
    """
    rows = hits.select("query_id", "side", "id", _finite(F.col("score")).alias("score"), F.col("rank").cast("double").alias("rank"))
    rows = rows.where(F.col("query_id").isNotNull() & F.col("side").isNotNull() & F.col("id").isNotNull())
    sign = sides.groupBy("side").agg(F.max(F.when(~F.col("higher_is_better"), -1.0).otherwise(1.0)).alias("sign"))
    rows = rows.join(sign, "side", "left").withColumn("s", F.col("score") * F.coalesce("sign", F.lit(1.0)))
    return rows.groupBy(*LIST, "id").agg(F.max("s").alias("s"), F.min("rank").alias("rank")).where(F.col("s").isNotNull() | F.col("rank").isNotNull())


def filled(rows: DataFrame) -> DataFrame:
    """``s`` of hits that have only a rank, interpolated between the nearest ranks of the list with a score.

    At an end of the list the nearest score is taken; a list without any score is
    ordered by rank. A list is cut into buckets of ranks, so that a list of any length
    is spread over tasks; what lies before and after a bucket is carried over.
    """
    rows = rows.withColumn("bucket", F.floor(F.col("rank") / RANK_BUCKET))
    known = F.when(F.col("s").isNotNull() & F.col("rank").isNotNull(), F.struct("rank", "s"))
    part = W.partitionBy(*LIST, "bucket")
    back, ahead = part.orderBy("rank", F.desc("s"), "id"), part.orderBy(F.desc("rank"), "s", "id")
    rows = rows.withColumn("low", F.last(known, True).over(back.rowsBetween(W.unboundedPreceding, 0))).withColumn("high", F.last(known, True).over(ahead.rowsBetween(W.unboundedPreceding, 0)))
    ends = rows.groupBy(*LIST, "bucket").agg(F.min(known).alias("first"), F.max(known).alias("last"), F.max(F.col("s").isNull()).alias("hole"))
    line = W.partitionBy(*LIST)
    carry = (
        ends.withColumn("before", F.last("last", True).over(line.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)))
        .withColumn("after", F.last("first", True).over(line.orderBy(F.desc("bucket")).rowsBetween(W.unboundedPreceding, -1)))
        .where("hole AND (before IS NOT NULL OR after IS NOT NULL)")
        .select(*LIST, "bucket", "before", "after")
    )
    rows = rows.join(carry, [*LIST, "bucket"], "left").withColumn("low", F.coalesce("low", "before")).withColumn("high", F.coalesce("high", "after"))
    width = F.col("high.rank") - F.col("low.rank")
    between = F.when(width > 0, F.col("low.s") + (F.col("high.s") - F.col("low.s")) * (F.col("rank") - F.col("low.rank")) / width)
    return rows.select(*LIST, "id", F.coalesce("s", between, "low.s", "high.s", -F.col("rank")).alias("s"))


def _log_squash(z: Column) -> Column:
    """log(1 / (1 + exp(-z))) for any z."""
    return -(F.greatest(-z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))))


def placed(scored: DataFrame, order: list[Column], rough: str) -> DataFrame:
    """``place`` of every item of its query, by ``order``, which begins with ``rough`` ascending.

    The items of a query are cut into ranges of ``rough`` by a mergeable sketch, counted
    and numbered range by range, so that no task holds all items of a long query.
    """
    cuts = scored.groupBy("query_id").agg(F.percentile_approx(rough, [i / CUTS for i in range(1, CUTS)], 1_000).alias("cuts"))
    rows = scored.join(cuts, "query_id").withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col(rough)))).drop("cuts")
    sizes = rows.groupBy("query_id", "range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("query_id").orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.join(sizes.select("query_id", "range", F.coalesce(before, F.lit(0)).alias("before")), ["query_id", "range"])
    return rows.withColumn("place", (F.col("before") + F.row_number().over(W.partitionBy("query_id", "range").orderBy(*order))).cast("int"))


def ranked(hits: DataFrame, sides: DataFrame, weights: Mapping[str, float] | None = None, top: int | None = None) -> DataFrame:
    """(query_id, id, score, place): all items of each query, best first.

    score is the weighted geometric mean over every side that served the query. In a
    list that did not return an item the item stands one deviation below the last one.
    The deviation is 1.4826 times the median absolute one; where that is 0 the mean
    absolute deviation, and where that is 0 too all items of the list are equal. Items
    whose logarithms agree to twelve decimals stand by their summed deviations, then by
    id. An empty table gives no rows.
    """
    rows = staged(filled(staged(clean_hits(hits, sides), "hits")), "filled")
    middle = rows.groupBy(*LIST).agg(F.percentile_approx("s", 0.5, ACCURACY).alias("med"))
    off = F.abs(F.col("s") - F.col("med"))
    spread = rows.join(middle, LIST).groupBy(*LIST).agg((F.percentile_approx(off, 0.5, ACCURACY) * 1.4826).alias("mad"), F.avg(off).alias("mean_off"), F.first("med").alias("med"), F.min("s").alias("worst"))
    unit = F.when(F.col("mad") > 0, F.col("mad")).when(F.col("mean_off") > 0, F.col("mean_off")).otherwise(F.lit(1.0))
    weight = F.coalesce(*[F.when(F.col("side") == k, F.lit(float(v))) for k, v in (weights or {}).items()], F.lit(1.0))
    off = lambda s: F.greatest(F.least((F.col(s) - F.col("med")) / F.col("unit"), F.lit(FARTHEST)), F.lit(-FARTHEST))
    lists = spread.select(*LIST, "med", unit.alias("unit"), "worst", weight.alias("w"))
    lists = staged(lists.select(*LIST, "med", "unit", "w", (off("worst") - 1).alias("last")).withColumn("floor", _log_squash(F.col("last"))), "lists")
    hit = rows.join(lists, LIST).select("query_id", "id", "w", "floor", "last", off("s").alias("z"))
    items = hit.groupBy("query_id", "id").agg(
        F.count("*").alias("n"),
        *[F.sum(F.col("w") * c).alias(k) for k, c in (("log", _log_squash(F.col("z"))), ("z", F.col("z")), ("floor", F.col("floor")), ("last", F.col("last")))],
    )
    whole = lists.groupBy("query_id").agg(F.count("*").alias("sides"), F.sum("w").alias("weight"), F.sum(F.col("w") * F.col("floor")).alias("floors"), F.sum(F.col("w") * F.col("last")).alias("lasts"))
    absent = lambda all_, mine: F.when(F.col("n") == F.col("sides"), F.lit(0.0)).otherwise(F.col(all_) - F.col(mine))
    mean = (F.col("log") + absent("floors", "floor")) / F.col("weight")
    scored = items.join(whole, "query_id").select("query_id", "id", F.round(F.exp(mean), 9).alias("score"), F.round(-mean, 12).alias("_low"), F.round((F.col("z") + absent("lasts", "last")) / F.col("weight"), 6).alias("_z"))
    order = [F.col("_low"), F.desc("_z"), F.col("id")]
    if top is None:
        return placed(scored, order, "_low").select("query_id", "id", "score", "place")
    return scored.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("place") <= top).select("query_id", "id", "score", "place")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, id) of the five best items of each query."""
    return ranked(table(spark, sf_dir, "hits"), table(spark, sf_dir, "sides"), top=5).select("query_id", "id")


def p1_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, id, score, place) of every item of every query."""
    return ranked(table(spark, sf_dir, "hits"), table(spark, sf_dir, "sides"))
