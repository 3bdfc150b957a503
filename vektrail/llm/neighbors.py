"""Most similar vectors for every vector.

Method: stable projections indexed by a kd-tree, in two increments. First every row
meets the rows of its own leaf; what it found there gives its own search distance: to
its k-th neighbour so far, or the least cosine. With that distance it descends the
tree, nearest branches first in the sense that a branch is left out where the
chi-square test holds, and the rows of the remaining leaves are verified. A verified
pair counts for both of its rows, so a neighbour is missed only if each of the two
left out the other's leaf.

Where many rows lie close together their distances are short, so they visit few
leaves, however many such rows there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vektrail.llm.vectors import DIM, LEAF_ROWS, MIN_COS, MISS, ROUTED, Table, _fresh, _routed, _spans, fit_tree, members, tables
from vektrail.session import staged

K = 5
BLOCK = 256
SPARE = 3  # beyond k, against float32 rounding before the float64 check
LEAST = np.float32(MIN_COS - 1e-6)
NEAR = np.dtype([("n", "S16"), ("cos", "<f8")])  # one found neighbour in the body of a result
RESULT, VISIT = 0, 1


def _best(group: np.ndarray, value: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest values of each group, by group."""
    order = np.lexsort((-value, group))
    g = group[order]
    first = np.concatenate(([0], np.flatnonzero(np.diff(g)) + 1)) if len(g) else np.empty(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(first, np.diff(np.concatenate((first, [len(g)]))))
    return order[rank < k]


def _top(cos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the best k + SPARE of each row, none under ``MIN_COS``; few or many qualify."""
    k = k + SPARE
    flat = np.flatnonzero(cos >= LEAST)
    if len(flat) <= 4 * k * len(cos) or cos.shape[1] <= k:
        i, j = np.divmod(flat, cos.shape[1])
        best = _best(i, cos.ravel()[flat], k)
        return i[best], j[best]
    j = np.argpartition(-cos, k, axis=1)[:, :k]
    i = np.repeat(np.arange(len(cos)), k)
    good = cos[i, j.ravel()] >= LEAST
    return i[good], j.ravel()[good]


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.round(np.einsum("ij,ij->i", a.astype("f8"), b.astype("f8")), 9)


class Found:
    """The k best (row, other, cosine) so far; shrunk as they come."""

    def __init__(self, k: int):
        self.k, self.parts, self.held = k, [], 0

    def add(self, row: np.ndarray, other: np.ndarray, cos: np.ndarray) -> None:
        self.parts.append((row, other, cos))
        self.held += len(row)
        if self.held > 400_000:
            self.shrink()

    def shrink(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        row, other, cos = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        top = _best(row, cos, self.k)
        self.parts, self.held = [(row[top], other[top], cos[top])], len(top)
        return self.parts[0]

    def bodies(self, names: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """(rows, their neighbours as bytes, cosine of the k-th or -1) of the rows that found any; names are the keys of ``other``."""
        row, other, cos = self.shrink()
        near = np.empty(len(row), NEAR)
        near["n"], near["cos"] = names[other], cos
        who, first, n = np.unique(row, return_index=True, return_counts=True)
        kth = np.where(n >= self.k, cos[np.minimum(first + self.k - 1, max(0, len(cos) - 1))], -1.0)
        raw = near.tobytes()
        return who, [raw[a * NEAR.itemsize : (a + c) * NEAR.itemsize] for a, c in zip(first.tolist(), n.tolist(), strict=True)], kth


def _names(keys: list[bytes]) -> np.ndarray:
    """Content keys as fixed-width bytes; such an array drops trailing zeros only when read as objects."""
    return np.frombuffer(b"".join(keys), "S16") if keys else np.empty(0, "S16")


def links(source: Table, k: int = K, miss: float = MISS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(q, n, cos, place): the k nearest other contents of each content, by key."""
    spark = source.rows.sparkSession
    tree = fit_tree(source, miss, leaf_rows)
    shared = spark.sparkContext.broadcast(tree)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        tree = shared.value
        slots, start = tree.slots()
        for b in batches:
            rows, keys = _fresh(b.column(0), seen)
            leaf = tree.home(rows @ tree.directions)
            part = np.array([key[0] for key in keys], np.int64) % tree.blocks[leaf]
            yield _routed(slots[start[leaf] + part], [VISIT] * len(keys), keys, [r.tobytes() for r in rows])

    def at_home(slot: int, keys: list[bytes], own: np.ndarray) -> Iterator[pa.RecordBatch]:
        tree, found = shared.value, Found(k)
        slots, start = tree.slots()
        for lo in range(0, len(own), BLOCK):
            cos = own[lo : lo + BLOCK] @ own.T
            at = np.arange(len(cos))
            cos[at, lo + at] = -2
            i, j = _top(cos, k)
            found.add(lo + i, j, _exact(own[lo + i], own[j]))
        who, bodies, kth = found.bodies(_names(keys))
        yield _routed([slot] * len(who), [RESULT] * len(who), [keys[i] for i in who], bodies)
        least = np.full(len(own), MIN_COS)
        least[who] = np.maximum(MIN_COS, kth)
        row, leaf, _ = tree.visits(own @ tree.directions, 2 - 2 * least)
        home = int(np.searchsorted(start, np.flatnonzero(slots == slot)[0], "right")) - 1
        if tree.blocks[home] > 1:  # the other blocks of its own leaf
            row, leaf = np.concatenate([row, np.arange(len(own))]), np.concatenate([leaf, np.full(len(own), home)])
        for lo in range(0, len(row), 50_000):
            r, f = row[lo : lo + 50_000], leaf[lo : lo + 50_000]
            n = tree.blocks[f]
            part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            to, r = slots[np.repeat(start[f], n) + part], np.repeat(r, n)
            to, r = to[to != slot], r[to != slot]
            yield _routed(to, [VISIT] * len(r), [keys[i] for i in r], [own[i].tobytes() for i in r])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, keys, vecs = None, [], []
        for slot, _, some, rows in _spans(batches):
            if slot != current and keys:
                yield from at_home(current, keys, np.concatenate(vecs))
                keys, vecs = [], []
            current = slot
            keys += some
            vecs.append(rows)
        if keys:
            yield from at_home(current, keys, np.concatenate(vecs))

    def second(home: pa.Table, met: pa.Table) -> pa.Table:
        role = met.column("role").to_numpy()
        done = met.filter(pa.array(role == RESULT)).select(["h", "body"])
        met = met.filter(pa.array(role == VISIT))
        once = dict(zip(home.column("h").to_pylist(), home.column("body").to_pylist(), strict=True))
        keys, own = list(once), np.frombuffer(b"".join(once.values()), "<f4").reshape(-1, DIM)
        guests = met.column("h").to_pylist()
        rows = np.frombuffer(b"".join(met.column("body").to_pylist()), "<f4").reshape(-1, DIM)
        theirs, mine = Found(k), Found(k)
        for lo in range(0, len(rows), BLOCK) if keys else ():
            part = rows[lo : lo + BLOCK]
            cos = part @ own.T
            i, j = _top(cos, k)
            theirs.add(lo + i, j, _exact(part[i], own[j]))
            j, i = _top(cos.T, k)
            mine.add(j, lo + i, _exact(part[i], own[j]))
        outs = [done]
        for found, askers, others in ((theirs, guests, keys), (mine, keys, guests)):
            who, bodies, _ = found.bodies(_names(others))
            outs.append(pa.table({"h": pa.array([askers[i] for i in who], pa.binary()), "body": pa.array(bodies, pa.binary())}))
        return pa.concat_tables(outs)

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies = b.column(1).to_pylist()
            near = np.frombuffer(b"".join(bodies), NEAR)
            raw = near["n"].astype("S16").tobytes()
            q = b.column(0).take(pa.array(np.repeat(np.arange(len(bodies)), [len(x) // NEAR.itemsize for x in bodies])))
            n = pa.Array.from_buffers(pa.binary(), len(near), [None, pa.py_buffer(np.arange(0, 16 * len(near) + 1, 16, dtype="<i4").tobytes()), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([q, n, pa.array(near["cos"])], ["q", "n", "cos"])

    home = source.rows.select("raw").mapInArrow(route, ROUTED).repartition(tree.tasks, "slot")
    sent = home.sortWithinPartitions("slot", "h").mapInArrow(first, ROUTED).repartition(tree.tasks, "slot")
    seen = home.groupBy("slot").cogroup(sent.groupBy("slot")).applyInArrow(second, "h binary, body binary")
    seen = seen.mapInArrow(unpacked, "q binary, n binary, cos double").where(F.col("cos") >= MIN_COS)
    # the two of a pair may have visited each other: no pair may take two places
    w = W.partitionBy("q").orderBy(F.desc("cos"), "n")
    return seen.withColumn("r", F.dense_rank().over(w)).where(F.col("r") <= k).drop("r").distinct().withColumn("place", F.row_number().over(w))


def similar_pairs(source: Table, k: int = K, miss: float = MISS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(id_a, id_b): pairs of ids of which one is among the k most similar of the other.

    Identical vectors share one place in the search. Each of them has the others
    first, in order of their ids, then the members of the nearest other contents.
    Unusable vectors, and an empty table, give nothing.
    """
    who = staged(members(source), "members")
    smallest = who.withColumn("r", F.row_number().over(W.partitionBy("h").orderBy("id"))).where(F.col("r") <= k + 1)
    # written, so that the planner knows their size before anything is moved to meet them
    copies = staged(who.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "copies")
    first = staged(smallest.join(copies, "h", "left_semi").select("h", F.col("id").alias("nid"), "r"), "first")
    # of k + 1 ids any member finds k others; an id after its own is one place nearer
    own = who.join(first, "h").where((F.col("nid") != F.col("id")) & (F.col("r") - (F.col("nid") > F.col("id")).cast("int") <= k)).select("id", "nid")
    # places left after a vector's own copies and the copies of nearer contents
    near = links(source, k, miss, leaf_rows).join(copies.select(F.col("h").alias("n"), "c"), "n", "left").join(copies.select(F.col("h").alias("q"), F.col("c").alias("mine")), "q", "left")
    nearer = F.sum(F.coalesce("c", F.lit(1))).over(W.partitionBy("q").orderBy("place").rowsBetween(W.unboundedPreceding, -1))
    near = near.select("q", "n", (F.lit(k + 1) - F.coalesce("mine", F.lit(1)) - F.coalesce(nearer, F.lit(0))).alias("room")).where("room > 0")
    near = near.join(who.select(F.col("h").alias("q"), "id"), "q").select("id", "n", "room")
    near = near.join(smallest.select(F.col("h").alias("n"), F.col("id").alias("nid"), "r"), "n").where(F.col("r") <= F.col("room")).select("id", "nid")
    pairs = own.unionByName(near)
    return pairs.select(F.least("id", "nid").alias("id_a"), F.greatest("id", "nid").alias("id_b")).distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tab, id_a, id_b) over both vector tables."""
    parts = [similar_pairs(source).select(F.lit(source.name).alias("tab"), "id_a", "id_b") for source in tables(spark, sf_dir)]
    return parts[0].unionByName(parts[1])
