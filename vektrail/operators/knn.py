"""Exact top-k search of a query set against all rows, in blocks.

A block of queries meets each Arrow batch of documents in one matrix product; only
the k best of a batch leave it, and a window over (query) keeps the k best of all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vektrail.functions import vec
from vektrail.session import ship

DIGITS = 9  # scores are ordered at this many decimals, so that summation order cannot swap ties
BROADCAST_BYTES = 64 << 20  # of a query set sent to every executor; larger ones are joined block by block
BLOCK = 1_024
OUT = "query_id {q}, doc_id {d}, score double"


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(x, "f8") for x in column]) if len(column) else np.empty((0, 0))


def _block_top(qid, q: np.ndarray, did, d: np.ndarray, bias, k: int, self_mask: bool):
    """The k best of one block of documents for each query, ties by document id.

    Products are formed in single precision; whatever could be among the k best within
    the error of that is scored again in double precision.
    """
    outs = ([], [], [])
    d4 = d.astype("f4")
    longest = float(np.linalg.norm(d, axis=1).max(initial=0.0))
    shift = 0.0 if bias is None else float(np.abs(bias).max(initial=0.0))
    for lo in range(0, len(q), BLOCK):
        rows = q[lo : lo + BLOCK]
        score = rows.astype("f4") @ d4.T
        if shift:
            score += bias.astype("f4")
        if self_mask:
            score[np.asarray(qid[lo : lo + BLOCK])[:, None] == did[None, :]] = -np.inf
        if score.shape[1] > k:
            error = np.finfo("f4").eps * (q.shape[1] * np.linalg.norm(rows, axis=1) * longest + shift) + 10.0**-DIGITS
            floor = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k] - 2 * error
            i, j = np.nonzero((score >= floor[:, None]) & (score > -np.inf))
        else:
            i, j = np.nonzero(score > -np.inf)
        exact = np.empty(len(i))
        for at in range(0, len(i), 65_536):
            part = slice(at, at + 65_536)
            exact[part] = np.einsum("ij,ij->i", rows[i[part]], d[j[part]])
        outs[0].append(np.asarray(qid)[lo + i])
        outs[1].append(did[j])
        outs[2].append(np.round(exact + bias[j] if shift else exact, DIGITS))
    return [np.concatenate(o) if o else np.empty(0) for o in outs]


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


def _usable(rows: DataFrame, key: str, v: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull() & F.col(v).isNotNull() & (F.size(v) > 0))


def top_k(queries: DataFrame, docs: DataFrame, k: int, query_key: str = "id", doc_key: str = "id", v: str = "v", bias: str | None = None, self_mask: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank): the k documents of highest inner product plus ``bias``.

    rank counts from 0; ties go to the smaller document id. k is at least 1; fewer
    documents give fewer rows. With ``self_mask`` a query does not find the document
    of its own id. Rows with a null key or a null or empty vector take no part.
    Repeated documents each take a place. Empty sides give no rows.
    """
    k = max(1, int(k))
    ship(docs.sparkSession)
    queries = _usable(queries, query_key, v).select(F.col(query_key).alias("query_id"), F.col(v).alias("qv"))
    docs = _usable(docs, doc_key, v).select(F.col(doc_key).alias("doc_id"), F.col(v).alias("dv"), F.coalesce((F.col(bias) if bias else F.lit(0.0)).cast("double"), F.lit(0.0)).alias("b"))
    out = OUT.format(q=queries.schema["query_id"].dataType.simpleString(), d=docs.schema["doc_id"].dataType.simpleString())
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("qv")).alias("dim")).first()
    if not size.n:
        return _ranked(docs.sparkSession.createDataFrame([], out), k)
    if size.n * size.dim * 8 > BROADCAST_BYTES:
        return _ranked(_by_blocks(queries, docs, k, self_mask, size.n, out), k)
    local = queries.toPandas()
    shared = docs.sparkSession.sparkContext.broadcast((local.query_id.to_numpy(), _matrix(local.qv)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = shared.value
        for b in batches:
            if b.num_rows:
                did = b.column(0).to_numpy(zero_copy_only=False)
                d = b.column(1).values.to_numpy(zero_copy_only=False).astype("f8").reshape(b.num_rows, -1) if b.column(1).offset == 0 else _matrix(b.column(1).to_pylist())
                got = _block_top(qid, q, did, d, b.column(2).to_numpy(), k, self_mask)
                yield pa.RecordBatch.from_arrays([pa.array(got[0], b.schema.field(0).type if qid.dtype == did.dtype else None), pa.array(got[1], b.schema.field(0).type), pa.array(got[2], pa.float64())], ["query_id", "doc_id", "score"])

    return _ranked(docs.mapInArrow(run, out), k)


def _by_blocks(queries: DataFrame, docs: DataFrame, k: int, self_mask: bool, n: int, out: str) -> DataFrame:
    """For query sets too large to broadcast: a grid of query blocks and document blocks."""
    blocks = max(1, -(-n // 8_192))
    parts = max(8, blocks)
    grid = queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn("db", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    side = docs.withColumn("db", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def run(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(d):
            return pd.DataFrame({"query_id": [], "doc_id": [], "score": []})
        got = _block_top(q.query_id.to_numpy(), _matrix(q.qv), d.doc_id.to_numpy(), _matrix(d.dv), d.b.to_numpy(), k, self_mask)
        return pd.DataFrame(dict(zip(("query_id", "doc_id", "score"), got, strict=True)))

    return grid.groupBy("qb", "db").cogroup(side.groupBy("qb", "db")).applyInPandas(run, out)


def rescored(candidates: DataFrame, queries: DataFrame, docs: DataFrame, k: int, v: str = "v") -> DataFrame:
    """Fixed candidate sets (query_id, doc_id) ranked again by the full vectors; ids without a vector drop out."""
    q = queries.select(F.col("id").alias("query_id"), F.col(v).alias("qv"))
    d = docs.select(F.col("id").alias("doc_id"), F.col(v).alias("dv"))
    scored = candidates.select("query_id", "doc_id").distinct().join(q, "query_id").join(d, "doc_id")
    return _ranked(scored.select("query_id", "doc_id", F.round(vec.dot(F.col("qv"), F.col("dv")), DIGITS).alias("score")), k)


def matched_mean(ranked: DataFrame, docs: DataFrame, dim: int, v: str = "v") -> DataFrame:
    """(query_id, v): mean vector of the documents found for each query."""
    d = docs.select(F.col("id").alias("doc_id"), F.col(v).alias("dv"))
    return vec.average(ranked.join(d, "doc_id"), ["query_id"], "dv", "v", dim)


def search_one(docs: DataFrame, query: list[float], k: int, where=None, v: str = "v") -> DataFrame:
    """Search of a single query by cosine; ``where`` is applied before scoring."""
    docs = docs if where is None else docs.where(where)
    lit = F.array(*[F.lit(float(x)) for x in query])
    scored = _usable(docs, "id", v).select("id", F.round(vec.cosine(F.col(v), lit), DIGITS).alias("score"))
    best = scored.orderBy(F.desc("score"), "id").limit(max(1, k))
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "id")) - 1)  # k rows


def require_known(requested: DataFrame, docs: DataFrame, key: str = "id") -> DataFrame:
    """``docs`` of the requested ids; raises if one of them does not exist."""
    missing = requested.select(key).join(docs.select(key), key, "left_anti").limit(5).collect()
    if missing:
        raise KeyError(f"unknown ids, for example {[r[0] for r in missing]}")
    return docs.join(requested.select(key).distinct(), key, "left_semi")
