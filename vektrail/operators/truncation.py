"""What shorter and coarser vectors keep: a grid over dimension and precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vektrail.functions import vec
from vektrail.operators.knn import rescored, top_k
from vektrail.operators.metrics import mean_of, ndcg_per_query
from vektrail.session import staged

RESCORED = 200


def cells(width: int, dims: Sequence[int], precisions: Sequence[str]) -> list[tuple[int, str]]:
    """(dim, precision), widest first; dims beyond the width are cut to it and doubles removed."""
    return [(d, p) for d in sorted({min(int(x), width) for x in dims}, reverse=True) for p in precisions]


def storage(dim: int, width: int, precision: str) -> float:
    """Share of the bytes of full vectors."""
    return dim / width * vec.BYTES[precision] / 4


def coarse(rows: DataFrame, dim: int, precision: str) -> DataFrame:
    return rows.select("id", vec.quantize(vec.truncate(F.col("v"), dim), precision).alias("v"))


def grid(queries: DataFrame, docs: DataFrame, qrels: DataFrame, width: int, dims: Sequence[int], precisions: Sequence[str], k: int = 10, self_mask: bool = True) -> DataFrame:
    """(dim, precision, retained, rescored, storage): one row per cell.

    Both sides are truncated and quantised. ``retained`` is the mean nDCG divided by that
    of full vectors (NaN if that is 0); ``rescored`` the same after ordering the first
    200 by full vectors. The loop is over cells, each a distributed search.
    """
    spark = docs.sparkSession

    def ndcg(ranked: DataFrame) -> float:
        return mean_of(ndcg_per_query(ranked, qrels, k), "ndcg", 0.0).first()[0]

    base = ndcg(top_k(queries, docs, k, self_mask=self_mask))
    out = []
    for dim, precision in cells(width, dims, precisions):
        found = staged(top_k(coarse(queries, dim, precision), coarse(docs, dim, precision), max(k, RESCORED), self_mask=self_mask), "cell")
        again = rescored(found, queries, docs, k)
        ratio = (lambda x: x / base) if base else (lambda x: float("nan"))
        out.append((dim, precision, ratio(ndcg(found)), ratio(ndcg(again)), storage(dim, width, precision)))
    return spark.createDataFrame(out, "dim int, precision string, retained double, rescored double, storage double")


def cheapest_above(measured: DataFrame, floor: float) -> DataFrame:
    """The cell of least storage that retains ``floor``; at equal storage the one that retains more. No row if none does."""
    return measured.where(F.col("retained") >= floor).orderBy("storage", F.desc("retained"), "dim", "precision").limit(1)
