"""Sampling and splitting, reproducible in any engine: order is given by an MD5 of seed and id.

The draws are equal in distribution to those of a random generator, not draw by draw.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEAST_ROWS = 200


def draw(seed: int, key: str | Column) -> Column:
    """The row's place in the random order: 32 bits of an MD5, then ties by id at the call site."""
    key = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), key)), 1, 8), 16, 10).cast("long")


def uniform(rows: DataFrame, size: int, seed: int = 0, key: str = "id", least: int = LEAST_ROWS) -> DataFrame:
    """``size`` rows without replacement (all, if there are fewer); fewer than ``least`` rows are an error."""
    if rows.limit(least).count() < least:
        raise ValueError(f"at least {least} rows are needed")
    return rows.orderBy(draw(seed, key), key).limit(size)


def cluster_count(n: int) -> int:
    """int(sqrt(n) / 2), between 8 and 64."""
    return int(min(64, max(8, math.sqrt(n) / 2)))


def quotas(counts: Mapping[object, int], size: int) -> dict:
    """How many rows each cluster gives.

    Every live cluster has a floor of max(1, size // (4 * clusters)), limited by its
    rows. The rest is proportional, rounded down; left-overs go one each by largest
    fraction, then one each by largest room, until spent. Ties go by the order given. A size under
    the number of live clusters gives one each.
    """
    rows = np.array([max(0, n) for n in counts.values()], dtype=np.int64)
    want = min(size, int(rows.sum()))
    share = np.minimum(rows, max(1, want // max(1, 4 * np.count_nonzero(rows)))) if want > 0 else np.zeros_like(rows)
    spare = want - int(share.sum())
    if spare > 0:
        part, rest = np.divmod(spare * rows, rows.sum())
        share = np.minimum(rows, share + part)
        by_fraction = [i for i in np.argsort(-rest, kind="stable") if share[i] < rows[i]]
        share[by_fraction[: want - int(share.sum())]] += 1
        # levelling: whole rounds over all clusters with room, then a last one in part
        while (spare := want - int(share.sum())) > 0:
            room = rows - share
            open_ = [i for i in np.argsort(-room, kind="stable") if room[i] > 0]
            rounds = min(int(room[open_].min()), spare // len(open_))
            share[open_ if rounds else open_[:spare]] += rounds or 1
    return dict(zip(counts, share.tolist(), strict=True))


def stratified(rows: DataFrame, size: int, cluster: str, seed: int = 0, key: str = "id", weight: str | None = None) -> DataFrame:
    """A sample with the quota of each cluster; within a cluster without replacement.

    With ``weight`` the order is that of -ln(u) / w, so a row's chance follows its
    weight; rows of weight 0 come last. Rows without a cluster are not drawn. Only the
    counts of the clusters reach the driver.
    """
    counts = {r[cluster]: r["count"] for r in rows.where(F.col(cluster).isNotNull()).groupBy(cluster).count().orderBy(cluster).collect()}
    plan = rows.sparkSession.createDataFrame(sorted(quotas(counts, size).items()), f"{cluster} {rows.schema[cluster].dataType.simpleString()}, _quota int")
    order = draw(seed, key) if weight is None else weighted_key(seed, key, weight)
    picked = rows.join(plan, cluster).withColumn("_rn", F.row_number().over(W.partitionBy(cluster).orderBy(order, key)))
    return picked.where(F.col("_rn") <= F.col("_quota")).drop("_rn", "_quota")


def clustered(rows: DataFrame, clusters: int | None = None, seed: int = 0, v: str = "v", key: str = "id", sample: int = 50_000) -> DataFrame:
    """``rows`` with a column cluster: k-means on unit vectors, fitted on at most ``sample`` rows and applied to all.

    ``clusters`` is by default ``cluster_count`` of the rows, and at most their number.
    Rows with a null or empty vector have a null cluster.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from vektrail.functions import vec

    good = rows.where(F.col(v).isNotNull() & (F.size(v) > 0)).select(key, array_to_vector(vec.l2_normalize(F.col(v))).alias("features"))
    n = good.count()
    if not n:
        return rows.withColumn("cluster", F.lit(None).cast("int"))
    k = max(1, min(clusters or cluster_count(n), n))
    found = KMeans(k=max(2, k), seed=seed, maxIter=20).fit(reservoir(good, sample, seed, key)).transform(good) if k > 1 and n > 1 else good.withColumn("prediction", F.lit(0))
    return rows.join(found.select(key, F.col("prediction").alias("cluster")), key, "left")


def sampled(rows: DataFrame, size: int, strategy: str = "stratified", seed: int = 0, key: str = "id", v: str = "v", weight: str | None = None) -> DataFrame:
    """A sample by the strategy of that name: ``uniform``, ``stratified`` (over k-means clusters) or ``reservoir``."""
    if strategy == "uniform":
        return uniform(rows, size, seed, key)
    if strategy == "reservoir":
        return reservoir(rows, size, seed, key)
    if strategy == "stratified":
        return stratified(clustered(rows, None, seed, v, key), size, "cluster", seed, key, weight)
    raise ValueError(f"unknown strategy {strategy}: uniform, stratified and reservoir are known")


def drawn(rows: DataFrame, size: int, query_size: int, strategy: str = "stratified", seed: int = 0, key: str = "id", v: str = "v", weight: str | None = None, least_fit: int = LEAST_ROWS) -> DataFrame:
    """The whole draw: a sample by strategy, then its disjoint query and fit sides (column role)."""
    return split(sampled(rows, size, strategy, seed, key, v, weight), query_size, seed, key, weight, least_fit)


def weighted_key(seed: int, key: str, weight: str) -> Column:
    """Efraimidis-Spirakis key -ln(u) / w; the smallest keys are drawn. Weights of 0 or null come last."""
    u = (draw(seed, key) + 1) / F.lit(4294967297.0)
    return F.when(F.col(weight) > 0, F.round(-F.ln(u) / F.col(weight), 12)).otherwise(F.lit(float("inf")))


def split(rows: DataFrame, query_size: int, seed: int = 0, key: str = "id", weight: str | None = None, least_fit: int = LEAST_ROWS) -> DataFrame:
    """``rows`` with a column role, ``query`` or ``fit``; the two never overlap.

    The query side has at most half of the rows; a fit side under ``least_fit`` is an error.
    """
    n = rows.count()
    query_size = min(query_size, max(1, n // 2))
    if n - query_size < least_fit:
        raise ValueError(f"{n - query_size} rows are left to fit on, {least_fit} are needed")
    order = draw(seed, key) if weight is None else weighted_key(seed, key, weight)
    chosen = rows.select(key, order.alias("_o")).orderBy("_o", key).limit(query_size).select(key, F.lit("query").alias("role"))
    return rows.join(chosen, key, "left").withColumn("role", F.coalesce("role", F.lit("fit")))


def access_weights(rows: DataFrame, counts: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` with a weight: the access count of an id, 1 where it is missing; null if all weights are 1."""
    joined = rows.join(counts.select(key, F.col("count").cast("double").alias("_c")), key, "left").withColumn("weight", F.coalesce("_c", F.lit(1.0))).drop("_c")
    flat = joined.agg((F.min("weight") == 1.0) & (F.max("weight") == 1.0)).first()[0]
    return joined.withColumn("weight", F.lit(None).cast("double")) if flat else joined


def reservoir(rows: DataFrame, size: int, seed: int = 0, key: str = "id") -> DataFrame:
    """At most ``size`` rows of a table of any length: a distributed top-k by hash order."""
    return rows.orderBy(draw(seed, key), key).limit(size)
