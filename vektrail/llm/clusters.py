"""Grouping vectors into clusters of similar ones, with size and typical members.

Method: power-iteration spectral clustering, on a coarsened affinity.

1. *Sparse affinity.* The leaves of the kd-tree give the links of cosine ``MIN_COS`` or
   more. Vectors connected inside a leaf are one piece, so a dense cluster costs one row
   per member and not one per pair. The affinity of two pieces is the mean cosine of the
   links between them, that of a piece with itself is 1.
2. *Power iteration.* D^-1 A is applied to several random vectors at once, ``STEPS``
   times. On connected pieces that are few it converges to a constant; on long chains
   neighbours come close to each other.
3. *k-means on the embedding.* Centres are seeded at the pieces whose hash is least
   among those they have affinity with. Every piece joins the nearest centre within
   ``RADIUS`` among those it has affinity with, and the centres move to the mean of their
   members until no piece changes.
4. The clusters become the pieces of the next level, with the mean of the affinities
   between them, and the iteration starts again. It ends when no affinity is left between
   two clusters: then the clusters are the connected ones. A level that merges nothing
   is repeated with twice as many steps.

Nothing else joins pieces: without power iteration the random vectors of linked pieces
lie further apart than ``RADIUS``, and nothing is merged.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vektrail.llm.vectors import DIM, LEAF_ROWS, MIN_COS, LeafKernel, Table, content_key, fit_tree, members, tables, unit, usable, visit_leaves
from vektrail.session import staged

STEPS = 4
VECTORS = 4
RADIUS = 0.1  # of a cluster in the embedding, whose random vectors start in the unit cube
ROUNDS = 4  # of k-means within a level, at most; what is left goes on in the next level
CLUSTER_MISS = 0.02  # a pair that links two pieces has no second chance, so leaves are visited further than for neighbours
INCIDENCE = "h binary, e binary, cos double"

log = logging.getLogger(__name__)


class PieceKernel(LeafKernel):
    """Emits (vector, piece, mean cosine): connected pieces of the leaf's own rows, and visitors linked to them."""

    def inside(self) -> None:
        n = len(self.own)
        piece = np.arange(n)
        self.linked = np.zeros(n, dtype=bool)
        self.degree, self.count = np.zeros(n), np.zeros(n, np.int64)
        for lo in range(0, n, self.BLOCK):
            i, j, cos = self.pairs(self.own[lo : lo + self.BLOCK], self.own)
            i += lo
            apart = i != j
            self.linked[i[apart]] = True
            self.degree += np.bincount(i[apart], cos[apart], n)
            self.count += np.bincount(i[apart], minlength=n)
            piece = self.join(piece, i[apart], j[apart])
        self.piece = piece

    @staticmethod
    def join(piece: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Unite the pieces of i and j; every label stays the smallest of its piece."""
        while True:
            a, b = piece[i], piece[j]
            differ = a != b
            if not differ.any():
                return piece
            high, low = np.maximum(a, b)[differ], np.minimum(a, b)[differ]
            parent = np.arange(len(piece))
            np.minimum.at(parent, high, low)
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
            piece = parent[piece]

    def name(self, piece: np.ndarray) -> list[bytes]:
        return [self.own_keys[p] for p in piece]  # the content key of its first row: the same on every part of a leaf

    @staticmethod
    def batch(keys: list[bytes], pieces: list[bytes], cos: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(pieces, pa.binary()), pa.array(np.round(cos, 6), pa.float64())], ["h", "e", "cos"])

    def visit(self, keys: np.ndarray, vecs: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.build()
        for lo in range(0, len(vecs), self.BLOCK) if len(self.own) else ():
            i, j, cos = self.pairs(vecs[lo : lo + self.BLOCK], self.own)
            if len(i):
                self.linked[j] = True
                seen, at, n = np.unique(i * len(self.own) + self.piece[j], return_inverse=True, return_counts=True)
                who, piece = np.divmod(seen, len(self.own))
                yield self.batch(keys[lo + who].tolist(), self.name(piece), np.bincount(at, cos) / n)

    def end(self) -> Iterator[pa.RecordBatch]:
        self.build()
        at = np.flatnonzero(self.linked)
        if len(at):
            mean = np.where(self.count[at] > 0, self.degree[at] / np.maximum(1, self.count[at]), 1.0)
            yield self.batch(self.own_keys[at].tolist(), self.name(self.piece[at]), mean)


def pieces(source: Table, miss: float = CLUSTER_MISS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Sparse incidence (h, e, cos) of vectors and connected pieces; rows without any link are absent."""
    seen = visit_leaves(source, fit_tree(source, miss, leaf_rows), PieceKernel, INCIDENCE, 2 - 2 * MIN_COS)
    return seen.groupBy("h", "e").agg(F.max("cos").alias("cos"))  # the blocks of a leaf repeat its pieces


def coarsened(incidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(h, e) with one piece per vector, and the affinity (a, b, cos) between pieces, both ways.

    A vector in several pieces links the least of them with each of the others, so a
    vector costs one row per piece and not one per pair of them.
    """
    first = incidence.groupBy("h").agg(F.min("e").alias("e"), F.count("*").alias("n"))
    many = first.where("n > 1").select("h", F.col("e").alias("a"))
    one_way = many.join(incidence, "h").where("a <> e").groupBy("a", F.col("e").alias("b")).agg(F.avg("cos").alias("cos"))
    return first.select("h", "e"), both_ways(one_way)


def both_ways(links: DataFrame) -> DataFrame:
    back = links.select(F.col("b").alias("a"), F.col("a").alias("b"), "cos")
    return links.select("a", "b", "cos").unionByName(back).groupBy("a", "b").agg(F.avg("cos").alias("cos"))


def _start(node: str, level: int, names: list[str]) -> list[Column]:
    return [(F.pmod(F.xxhash64(node, F.lit(level), F.lit(i)), F.lit(1 << 40)) / F.lit(float(1 << 40))).alias(n) for i, n in enumerate(names)]


def power_iteration(affinity: DataFrame, steps: int = STEPS, vectors: int = VECTORS, level: int = 0) -> DataFrame:
    """(a, x0, x1, ...): D^-1 (A + I) applied ``steps`` times to random vectors.

    A step is one join and one sum with map-side combining, so neither a node with
    many links nor a large cluster is gathered in one task. Each step is written to the
    shared folder: its plan stays short and a lost executor repeats one step.
    """
    names = [f"x{i}" for i in range(vectors)]
    loops = affinity.select("a", F.col("a").alias("b"), F.lit(1.0).alias("cos")).distinct()
    whole = staged(affinity.select("a", "b", "cos").unionByName(loops), "affinity")
    far = whole.select("a", "b", "cos", *_start("b", level, names))
    x = None
    for _ in range(steps):
        rows = far if x is None else whole.join(x.withColumnRenamed("a", "b"), "b")
        x = staged(rows.groupBy("a").agg(*[(F.sum(F.col("cos") * F.col(n)) / F.sum("cos")).alias(n) for n in names]), "power")
    return x


def k_means(affinity: DataFrame, embedding: DataFrame, radius: float = RADIUS, rounds: int = ROUNDS) -> DataFrame:
    """(a, label): k-means on the embedding, where a node may join centres it has affinity with.

    Seeds are the nodes of least hash among those they are linked to. A node takes the
    nearest centre within ``radius`` that one of its links (or itself) belongs to, ties
    by label; then the centres move. It ends when no node changes.
    """
    names = [c for c in embedding.columns if c != "a"]
    code = lambda c: F.struct(F.xxhash64(c), F.col(c))
    low = affinity.groupBy("a").agg(F.min(code("b")).alias("low"))
    seeds = embedding.join(low, "a").select("a", *names, F.when(code("a") < F.col("low"), F.col("a")).alias("label"))
    state = staged(seeds.withColumn("changed", F.lit(True)), "seeds")
    for n in range(rounds):
        held = state.where("label IS NOT NULL")
        centre = held.groupBy("label").agg(*[F.avg(n).alias("c" + n) for n in names])
        options = affinity.join(held.select(F.col("a").alias("b"), "label"), "b").select("a", "label").unionByName(held.select("a", "label")).join(centre, "label")
        gap = sum(((F.col(n) - F.col("c" + n)) ** 2 for n in names[1:]), (F.col(names[0]) - F.col("c" + names[0])) ** 2)
        rows = state.select("a", *names, F.col("label").alias("was")).join(options, "a", "left").withColumn("gap", F.round(gap, 12))
        near = F.when(F.col("gap") <= radius * radius, F.struct("gap", "label"))
        best = rows.groupBy("a").agg(*[F.first(n).alias(n) for n in names], F.first("was").alias("was"), F.min(near).alias("m"))
        new = best.select("a", *names, F.coalesce("m.label", "was").alias("label"), (~F.coalesce("m.label", "was").eqNullSafe(F.col("was"))).alias("changed"))
        state = staged(new, "means")
        if n and state.where("changed").isEmpty():
            break
    return state.select("a", F.coalesce("label", "a").alias("label"))


def merged(affinity: DataFrame, steps: int = STEPS, vectors: int = VECTORS, levels: int = 64) -> DataFrame:
    """(e, label) of the pieces that have affinity with another one: their cluster, by levels of power iteration and k-means.

    Ends when no affinity is left between clusters; at least one step is needed, and
    the levels are only a guard against an endless loop.
    """
    if steps < 1:
        raise ValueError("without power iteration nothing is merged")
    found = affinity.select(F.col("a").alias("e")).distinct().withColumn("label", F.col("e"))
    left = affinity.select("a").distinct().count()
    for level in range(levels):
        if not left:
            return found
        to = k_means(affinity, power_iteration(affinity, steps, vectors, level))
        at = affinity.join(to, "a").select(F.col("label").alias("a"), "b", "cos")
        at = at.join(to.select(F.col("a").alias("b"), F.col("label").alias("_b")), "b").select("a", F.col("_b").alias("b"), "cos")
        affinity = staged(at.where("a <> b").groupBy("a", "b").agg(F.avg("cos").alias("cos")), "affinity")
        before, left = left, affinity.select("a").distinct().count()
        log.info("level %d, %d steps: %d pieces with affinity to others, %d left", level, steps, before, left)
        steps = 2 * steps if left == before else steps
        found = found.join(to.select(F.col("a").alias("label"), F.col("label").alias("_to")), "label", "left").select("e", F.coalesce("_to", "label").alias("label"))
        if level % 4 == 3:
            found = staged(found, "found")
    raise RuntimeError(f"affinities are left between clusters after {levels} levels")


def assign(incidence: DataFrame, steps: int = STEPS, vectors: int = VECTORS) -> DataFrame:
    """(h, label): the cluster of each linked vector; label is the key of one of its pieces."""
    of, affinity = coarsened(incidence)
    found = merged(staged(affinity, "affinity"), steps, vectors)
    return of.join(found, "e", "left").select("h", F.coalesce("label", "e").alias("label"))


def clusters_of(sources: Sequence[Table], miss: float = CLUSTER_MISS, leaf_rows: int = LEAF_ROWS) -> list[DataFrame]:
    """(id, h, label) of every usable vector of each table; an unlinked one is its own cluster with its copies.

    The tables are iterated together, which halves the steps; a byte in front of the
    keys keeps them apart. Identical vectors of a table are in one cluster. Unusable
    vectors are in none; an empty table gives no rows.
    """
    marks = [F.lit(bytes([i])) for i in range(len(sources))]
    parts = [pieces(source, miss, leaf_rows).select(F.concat(m, "h").alias("h"), F.concat(m, "e").alias("e"), "cos") for m, source in zip(marks, sources, strict=True)]
    found = assign(staged(reduce(DataFrame.unionByName, parts), "pieces"))
    out = []
    for m, source in zip(marks, sources, strict=True):
        mine = found.where(F.substring("h", 1, 1) == m).select(F.substring("h", 2, 16).alias("h"), "label")
        out.append(members(source).join(mine, "h", "left").select("id", "h", F.coalesce("label", "h").alias("label")))
    return out


def clusters(source: Table, miss: float = CLUSTER_MISS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``clusters_of`` one table."""
    return clusters_of([source], miss, leaf_rows)[0]


def of_size(rows: DataFrame, least: int = 3) -> DataFrame:
    """(label, cluster_id, size) of clusters of at least ``least`` members."""
    return rows.groupBy("label").agg(F.min("id").alias("cluster_id"), F.count("*").alias("size")).where(F.col("size") >= least)


def typical(source: Table, rows: DataFrame, top: int = 3, least: int = 3) -> DataFrame:
    """(cluster_id, size, place, id, affinity): the most typical members of each cluster.

    The internal affinity of a member is its mean cosine to the other members. The sum
    of cosines is the product with the sum of the members' unit vectors, so one vector
    per cluster is enough.
    """
    names = [f"v{i}" for i in range(DIM)]

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, vecs = usable(b.column(1))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(at)),
                    pa.array([content_key(r) for r in vecs], pa.binary()),
                    *[pa.array(c, pa.float64()) for c in (unit(vecs, "f8") if len(vecs) else vecs).astype("f8").T],
                ],
                ["id", "h", *names],
            )

    vec = source.rows.select("id", "raw").mapInArrow(units, "id string, h binary, " + ", ".join(f"{n} double" for n in names))
    kept = rows.join(of_size(rows, least), "label")
    full = vec.join(kept, ["id", "h"]).dropDuplicates(["id", "h"])  # the join has the rows where they are needed
    sums = full.groupBy("label").agg(*[F.sum(n).alias("s" + n) for n in names])
    dot = sum((F.col(n) * F.col("s" + n) for n in names[1:]), F.col(names[0]) * F.col("s" + names[0]))
    scored = full.join(sums, "label").select("cluster_id", "size", "id", F.round((dot - 1) / (F.col("size") - 1), 6).alias("affinity"))
    w = W.partitionBy("cluster_id").orderBy(F.desc("affinity"), "id")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tab, cluster_id, id) of the clusters of three and more."""
    sources = tables(spark, sf_dir)
    parts = []
    for source, rows in zip(sources, clusters_of(sources), strict=True):
        rows = staged(rows, "clusters")
        parts.append(rows.join(of_size(rows), "label").select(F.lit(source.name).alias("tab"), "cluster_id", "id"))
    return parts[0].unionByName(parts[1])


def p4_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tab, cluster_id, size, place, id, affinity): size and three most typical members of each cluster."""
    sources = tables(spark, sf_dir)
    parts = []
    for source, rows in zip(sources, clusters_of(sources), strict=True):
        parts.append(typical(source, staged(rows, "clusters")).select(F.lit(source.name).alias("tab"), "cluster_id", "size", "place", "id", "affinity"))
    return parts[0].unionByName(parts[1])
