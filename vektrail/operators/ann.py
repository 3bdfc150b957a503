"""Approximate search by cells, and the health of such an index.

Cells are k-means centres fitted on a bounded sample; every row is assigned to its
cell. A query looks into the ``probes`` nearest cells: an equi-join on the cell, so
nothing is broadcast but the centres.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vektrail.functions import vec
from vektrail.operators.knn import DIGITS, top_k
from vektrail.operators.sampling import reservoir

SAMPLE = 20_000  # rows the centres are fitted on


class CellIndex:
    """Rows (id, v) with their cell; ``rebuild`` refits the cells over the current vectors."""

    def __init__(self, rows: DataFrame, cells: int, seed: int = 0):
        self.cells, self.seed = cells, seed
        self.rebuild(rows)

    def rebuild(self, rows: DataFrame) -> None:
        data = reservoir(rows, SAMPLE, self.seed).select(array_to_vector(vec.l2_normalize(F.col("v"))).alias("features"))
        self.centres = np.stack(KMeans(k=self.cells, seed=self.seed, maxIter=10).fit(data).clusterCenters())
        self.rows = self.assigned(rows, 1).select("id", "v", "cell")

    def assigned(self, rows: DataFrame, probes: int) -> DataFrame:
        """(id, v, cell): one row for each of the ``probes`` nearest cells."""
        shared = rows.sparkSession.sparkContext.broadcast(self.centres)
        kind = rows.schema["id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = shared.value
            for b in batches:
                if b.num_rows:
                    v = np.stack([np.asarray(x, "f8") for x in b.column(1).to_pylist()])
                    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                    near = np.argsort(((v * v).sum(1)[:, None] - 2 * v @ c.T + (c * c).sum(1)), axis=1, kind="stable")[:, :probes]
                    at = pa.array(np.repeat(np.arange(b.num_rows), near.shape[1]))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(near.ravel(), pa.int32())], ["id", "v", "cell"])

        return rows.where(F.col("v").isNotNull() & (F.size("v") > 0)).select("id", vec.doubles(F.col("v")).alias("v")).mapInArrow(run, f"id {kind}, v array<double>, cell int")

    def search(self, queries: DataFrame, k: int, probes: int, self_mask: bool = False) -> DataFrame:
        """(query_id, doc_id, score, rank) by cosine within the probed cells."""
        q = self.assigned(queries, probes).select(F.col("id").alias("query_id"), F.col("v").alias("qv"), "cell")
        d = self.rows.select(F.col("id").alias("doc_id"), F.col("v").alias("dv"), "cell")
        pairs = q.join(d, "cell")
        pairs = pairs.where("query_id <> doc_id") if self_mask else pairs
        scored = pairs.select("query_id", "doc_id", F.round(vec.cosine(F.col("qv"), F.col("dv")), DIGITS).alias("score"))
        w = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        return scored.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


def probes_for(index: CellIndex, rows: DataFrame, least: float = 0.9, k: int = 10, sample: int = 200, seed: int = 0) -> tuple[int, float]:
    """(probes, recall): the fewest probed cells whose measured recall is at least ``least``; all cells are an exact search."""
    low, high, best = 1, index.cells, (index.cells, 1.0)
    while low <= high:
        mid = (low + high) // 2
        got = health(index, rows, k, mid, sample, seed).first().recall or 0.0
        if got >= least:
            best, high = (mid, got), mid - 1
        else:
            low = mid + 1
    return best


def health(index: CellIndex, rows: DataFrame, k: int = 10, probes: int = 4, sample: int = 200, seed: int = 0) -> DataFrame:
    """(recall, probes_sampled): share of the exact neighbours a search of the index finds, over sampled rows, self left out."""
    picked = reservoir(rows, sample, seed).select("id", vec.l2_normalize(F.col("v")).alias("v"))
    exact = top_k(picked, rows.select("id", vec.l2_normalize(F.col("v")).alias("v")), k, self_mask=True).select("query_id", "doc_id")
    found = index.search(picked, k, probes, self_mask=True).select("query_id", "doc_id", F.lit(1).alias("hit"))
    per = exact.join(found, ["query_id", "doc_id"], "left").groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("r"))
    return per.agg(F.avg("r").alias("recall"), F.count("*").alias("probes_sampled"))
