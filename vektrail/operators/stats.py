"""Offline statistics: intervals of proportions, exact and randomised tests, multiple testing."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vektrail.operators.metrics import hashed_draw

Z95 = 1.959963984540054  # fixed value: 97.5 % point of the normal law


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson interval of k successes of n; null for n = 0."""
    p, zz = k / F.when(n > 0, n), z * z
    mid = (p + zz / (2 * n)) / (1 + zz / n)
    half = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return mid - half, mid + half


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X >= k) of a binomial law."""
    if k <= 0:
        return 1.0
    if p <= 0 or k > n:
        return 0.0
    if p >= 1:
        return 1.0
    if p > (k + 1) / (n + 3):
        return 1.0 - binomial_tail(n - k + 1, n, 1 - p)
    # Continued fraction of the incomplete beta function. It ends by itself after n - k steps; about sqrt(n) are needed until nothing changes any more.
    c, d = 1.0, (k + 1) / (k + 1 - (n + 1) * p)
    fraction = d
    for m in range(1, n - k + 1):
        t = m * (n - k + 1 - m) * p / ((k + 2 * m - 1) * (k + 2 * m))
        c, d = 1 + t / c, 1 / (1 + t * d)
        fraction *= c * d
        t = -(k + m) * (n + 1 + m) * p / ((k + 2 * m) * (k + 2 * m + 1))
        c, d = 1 + t / c, 1 / (1 + t * d)
        fraction *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    first = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k + 1) * math.log1p(-p)
    return min(1.0, math.exp(first) * fraction)


def binomial_test(k: int, n: int, p: float = 0.5) -> float:
    """Two-sided exact test: total probability of the outcomes that are no more likely than k."""
    pmf = [math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)]
    return min(1.0, math.fsum(x for x in pmf if x <= pmf[k] * (1 + 1e-7)))


def clopper_pearson(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Exact interval by bisection of the binomial tails."""
    tail = (1 - level) / 2

    def solve(f) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(100):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if f(mid) else (lo, mid)
        return lo

    low = 0.0 if k == 0 else solve(lambda p: binomial_tail(k, n, p) < tail)
    high = 1.0 if k == n else solve(lambda p: 1 - binomial_tail(k + 1, n, p) > tail)
    return low, high


@F.pandas_udf(T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]))
def clopper_pearson_udf(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([clopper_pearson(int(a), int(b)) for a, b in zip(k, n, strict=True)], columns=["low", "high"])


def holm(tests: DataFrame, key: str = "name", p: str = "p") -> DataFrame:
    """Holm-Bonferroni adjusted p-values; a handful of tests, ordered in one window."""
    w = W.orderBy(p, key)
    rows = tests.where(F.col(p).isNotNull()).withColumn("_r", F.row_number().over(w)).withColumn("_n", F.count("*").over(W.partitionBy(F.lit(1))))
    step = F.least(F.lit(1.0), (F.col("_n") - F.col("_r") + 1) * F.col(p))
    return rows.withColumn("adjusted", F.max(step).over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_r", "_n")


def paired_randomisation(pairs: DataFrame, a: str, b: str, draws: int = 1_000, seed: int = 0, key: str = "id") -> DataFrame:
    """(observed, p): mean difference and two-sided p = (extreme + 1) / (draws + 1) under hashed sign flips."""
    diff = pairs.select(F.col(key).alias("k"), (F.col(a) - F.col(b)).alias("d")).where(F.col("d").isNotNull())
    seen = diff.agg(F.avg("d").alias("observed"))
    flips = diff.crossJoin(F.broadcast(diff.sparkSession.range(draws).withColumnRenamed("id", "b")))  # draws is a parameter
    sign = 1 - 2 * hashed_draw(seed, F.col("b"), F.col("k"), F.lit(2))
    means = flips.groupBy("b").agg(F.avg(F.col("d") * sign).alias("m"))
    joined = means.crossJoin(F.broadcast(seen))  # one row
    return joined.groupBy("observed").agg(((F.sum((F.abs("m") >= F.abs("observed") - 1e-12).cast("int")) + 1) / (draws + 1)).alias("p"))


def selection_permutation(rows: DataFrame, value: str, selected: str, draws: int = 1_000, seed: int = 0, key: str = "id") -> DataFrame:
    """(observed, p): mean of the selected rows against equally large hashed selections."""
    base = rows.select(F.col(key).alias("k"), F.col(value).alias("x"), F.col(selected).alias("s")).where(F.col("x").isNotNull())
    size = base.agg(F.sum(F.col("s").cast("int")).alias("size"), F.avg(F.when(F.col("s"), F.col("x"))).alias("observed"))
    grid = base.crossJoin(F.broadcast(base.sparkSession.range(draws).withColumnRenamed("id", "b")))  # draws is a parameter
    order = F.row_number().over(W.partitionBy("b").orderBy(F.md5(F.concat_ws("|", F.lit(seed), "b", "k")), "k"))
    means = grid.withColumn("r", order).crossJoin(F.broadcast(size)).where(F.col("r") <= F.col("size")).groupBy("b", "observed").agg(F.avg("x").alias("m"))  # one row
    return means.groupBy("observed").agg(((F.sum((F.col("m") >= F.col("observed") - 1e-12).cast("int")) + 1) / (draws + 1)).alias("p"))


def newest_results(rows: DataFrame, identity: list[str], order: list[str]) -> DataFrame:
    """One row per identity: the newest by ``order``."""
    w = W.partitionBy(*identity).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
