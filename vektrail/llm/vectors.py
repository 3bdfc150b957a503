"""Usable vectors of the two tables, and the projected kd-tree both vector operators share.

Unit vectors are projected on a few orthonormal Gaussian directions (Gaussian laws
are 2-stable, so a projected difference has variance d^2 per direction). A kd-tree
over a bounded sample of projections cuts the space into leaves; every row is put
into exactly one leaf. A row then descends the tree once more, with the distance it
searches for: a branch is left out where the chi-square test says that a neighbour at
that distance lies so far beyond the cuts on its way with a probability of at most
``miss``. The neighbour search uses each row's own distance, known from its leaf; the
cluster search uses the radius of a link.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vektrail.session import staged, table

DIM = 64
MIN_COS = 0.86
LEAF_ROWS = 16_000  # rows of a leaf, about
LEAST_LEAVES = 8
SAMPLE_ROWS = 20_000  # rows the tree is fitted on, about, or ``PER_LEAF`` for each leaf if that is more
PER_LEAF = 8
MOST_LEAVES = 1 << 18  # bounds the sample to 2 M projected rows; beyond it leaves are dealt out in blocks
DIRECTIONS = 16
MISS = 0.05
SMALL_ROWS = 200_000  # rows of three numbers that may be broadcast
ROUTED = "slot int, role int, h binary, body binary"
TASKS = 4_096  # of a search, at most; beyond it a task has several blocks


@dataclass(frozen=True)
class Table:
    """Rows (id string, raw) of one table and how to read ``raw``."""

    name: str
    rows: DataFrame
    about: DataFrame | None = None  # a table of about as many rows that can be counted without reading them


def current_documents(docs: DataFrame) -> DataFrame:
    """(id, raw) of vec_documents: of several rows of a doc_id the latest one.

    Only doc_ids with several rows are compared; the vectors of the others are
    never moved. Rows without doc_id are left out; a null written_utc is oldest.
    """
    stamp = F.struct("written_utc", F.xxhash64("embedding").alias("x"))
    docs = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "embedding", "written_utc")
    many = docs.groupBy("doc_id").agg(F.max(stamp).alias("top"), F.count("*").alias("n")).where("n > 1").select("doc_id", "top")
    many = staged(many, "replaced")
    if many.count() <= SMALL_ROWS:  # else the join shuffles both sides
        many = F.broadcast(many)
    kept = docs.withColumn("_s", stamp).join(many, "doc_id", "left").where(F.col("top").isNull() | (F.col("_s") == F.col("top")) | (F.col("_s.written_utc").isNull() & F.col("top.written_utc").isNull() & (F.col("_s.x") == F.col("top.x"))))
    return kept.select(F.col("doc_id").cast("string").alias("id"), F.col("embedding").alias("raw"))


def tables(spark: SparkSession, sf_dir: str) -> list[Table]:
    docs, cache = table(spark, sf_dir, "vec_documents"), table(spark, sf_dir, "vectors")
    blobs = cache.where(F.col("key").isNotNull()).select(F.col("key").alias("id"), F.col("vector").alias("raw"))
    return [Table("vec_documents", current_documents(docs), docs), Table("vectors", blobs, cache)]


def usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Positions and float32 rows of the usable vectors of a list or binary column.

    Usable: exactly ``DIM`` finite numbers, not all zero. Null elements count as not finite.
    """
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        parts = column.to_pylist()
        at = [i for i, b in enumerate(parts) if b is not None and len(b) == 4 * DIM]
        rows = np.frombuffer(b"".join(parts[i] for i in at), "<f4").reshape(-1, DIM)
        at = np.array(at, dtype=np.int64)
    else:
        sizes = pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(sizes == DIM)
        flat = pc.list_flatten(column.take(pa.array(at)))
        rows = flat.cast(pa.float32()).to_numpy(zero_copy_only=False).astype("f4").reshape(-1, DIM)
    good = np.isfinite(rows).all(1) & (rows != 0).any(1)
    return at[good], rows[good]


def unit(rows: np.ndarray, kind: str = "f4") -> np.ndarray:
    wide = rows.astype("f8")
    if not len(wide):
        return rows
    wide /= np.abs(wide).max(1, keepdims=True)  # lengths near the ends of the float range
    return (wide / np.linalg.norm(wide, axis=1, keepdims=True)).astype(kind)


def content_key(row: np.ndarray) -> bytes:
    """128 bits of the raw numbers; -0.0 is 0.0."""
    return hashlib.md5((row + np.float32(0)).astype("<f4").tobytes()).digest()


def chi2_tail(j: int, t: float) -> float:
    """P(chi-square with j degrees of freedom > t)."""
    h = t / 2
    if j % 2 == 0:
        return math.exp(-h) * sum(h**i / math.factorial(i) for i in range(j // 2))
    tail, term = math.erfc(math.sqrt(h)), math.sqrt(h) / math.gamma(1.5)
    for i in range(1, (j + 1) // 2):
        tail += math.exp(-h) * term
        term *= h / (i + 0.5)
    return tail


def stop_at(j: int, miss: float) -> float:
    """Squared projected distance, in units of d^2, at which a visit over j violated cuts ends.

    A neighbour must lie beyond all j cuts on their far sides, hence the factor 2^-j.
    """
    if 0.5**j <= miss:
        return 0.0
    lo, hi = 0.0, 400.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5**j * chi2_tail(j, mid) > miss else (lo, mid)
    return lo


def directions(seed: int = 7) -> np.ndarray:
    """Orthonormal Gaussian directions, scaled so that a unit difference has variance 1 in each."""
    rng = np.random.default_rng(seed)
    return (np.linalg.qr(rng.standard_normal((DIM, DIM)))[0][:, :DIRECTIONS] * math.sqrt(DIM)).astype("f4")


@dataclass(frozen=True)
class Tree:
    """A complete binary tree of cuts; inner node i has the children 2 i + 1 (below) and 2 i + 2."""

    directions: np.ndarray
    axis: np.ndarray
    cut: np.ndarray
    limit: np.ndarray  # squared projected distance at which a branch is left out, in units of d^2, by number of violated cuts
    blocks: np.ndarray  # into how many blocks a leaf is dealt

    @classmethod
    def fit(cls, points: np.ndarray, leaves: int, miss: float, blocks: np.ndarray | None = None) -> Tree:
        """Every cut is the median of the widest direction of the sample points inside."""
        axis, cut = np.zeros(leaves - 1, np.int64), np.zeros(leaves - 1)
        inside = [np.arange(len(points))]
        for node in range(leaves - 1):
            here = points[inside[node]]
            if len(here):
                axis[node] = here.var(0).argmax()
                cut[node] = np.median(here[:, axis[node]])
            below = here[:, axis[node]] < cut[node]
            inside += [inside[node][below], inside[node][~below]]
        limit = np.array([0.0] + [stop_at(j, miss) for j in range(1, DIRECTIONS + 1)])
        return cls(directions(), axis, cut, limit, np.ones(leaves, np.int64) if blocks is None else blocks)

    @property
    def leaves(self) -> int:
        return len(self.cut) + 1

    def home(self, y: np.ndarray) -> np.ndarray:
        """The leaf of each projected row."""
        node = np.zeros(len(y), np.int64)
        while len(node) and node[0] < self.leaves - 1:
            node = 2 * node + 1 + (y[np.arange(len(y)), self.axis[node]] >= self.cut[node])
        return node - (self.leaves - 1)

    def visits(self, y: np.ndarray, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, distance^2) of the other leaves where a row may have a neighbour at squared distance ``d2``.

        All rows descend at once. At a cut the near branch is free; the far one adds the
        violated cut to the row's projected distance and is left out where the test holds.
        """
        rows, leaves, far = [], [], []
        for lo in range(0, len(y), 2_048):
            at = y[lo : lo + 2_048]
            row, node, away = np.arange(len(at)), np.zeros(len(at), np.int64), np.zeros(len(at), bool)
            out = np.zeros((len(at), DIRECTIONS), y.dtype)
            while len(node) and node[0] < self.leaves - 1:
                axis = self.axis[node]
                beyond = at[row, axis] - self.cut[node]
                other = out.copy()
                other[np.arange(len(row)), axis] = np.abs(beyond)
                goes = (other * other).sum(1) <= self.limit[(other > 0).sum(1)] * d2[lo + row]
                side = (beyond >= 0).astype(np.int64)
                row, node = np.concatenate([row, row[goes]]), np.concatenate([2 * node + 1 + side, (2 * node + 2 - side)[goes]])
                out, away = np.concatenate([out, other[goes]]), np.concatenate([away, np.ones(goes.sum(), bool)])
            rows.append(lo + row[away])
            leaves.append(node[away] - (self.leaves - 1))
            far.append((out[away] ** 2).sum(1))
        if not rows:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        return np.concatenate(rows), np.concatenate(leaves), np.concatenate(far)


    @property
    def tasks(self) -> int:
        return int(min(self.blocks.sum(), TASKS))

    def slots(self) -> tuple[np.ndarray, np.ndarray]:
        """(slot of each block, first block of each leaf): the keys by which Spark's hash deals the blocks evenly to ``tasks``."""
        total, want = int(self.blocks.sum()), self.tasks
        key = np.arange(64 * total + 256)
        part = spark_hash(key) % want
        order = np.lexsort((key, part))
        turn = np.arange(len(key)) - np.searchsorted(part[order], part[order])
        taken = order[np.lexsort((part[order], turn))][:total]  # the first key of each task, then the second
        return key[taken], np.concatenate([[0], np.cumsum(self.blocks)[:-1]])


def spark_hash(x: np.ndarray) -> np.ndarray:
    """Spark's Murmur3 hash of int columns, seed 42, as signed 32-bit numbers."""
    u, turn = np.uint32, lambda v, n: (v << np.uint32(n)) | (v >> np.uint32(32 - n))
    h = u(42) ^ (turn(x.astype(u) * u(0xCC9E2D51), 15) * u(0x1B873593))
    h = (turn(h, 13) * u(5) + u(0xE6546B64)) ^ u(4)
    h = (h ^ (h >> u(16))) * u(0x85EBCA6B)
    h = (h ^ (h >> u(13))) * u(0xC2B2AE35)
    return (h ^ (h >> u(16))).view(np.int32)


def fit_tree(source: Table, miss: float = MISS, leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE_ROWS) -> Tree:
    """The tree over a bounded hash sample of the rows; every row is indexed later.

    The sample tells how full the leaves are: one that holds more than twice its rows
    is dealt out in blocks.
    """
    total = (source.about or source.rows).count()
    leaves = min(MOST_LEAVES, max(LEAST_LEAVES, 1 << math.ceil(math.log2(max(1, total / leaf_rows)))))
    every = max(1, total // max(sample_rows, PER_LEAF * leaves))
    picked = source.rows.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("raw")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, rows = usable(b.column(0))
            y = (unit(rows) @ directions()).astype("f4")
            yield pa.RecordBatch.from_arrays([pa.array([y.tobytes()], pa.binary())], ["y"])

    got = picked.mapInArrow(take, "y binary").toArrow().column(0).to_pylist()
    sample = np.frombuffer(b"".join(sorted(got)), "<f4").reshape(-1, DIRECTIONS)
    tree = Tree.fit(sample, leaves, miss)
    held = np.bincount(tree.home(sample), minlength=leaves) * (total / max(1, len(sample)))
    return Tree.fit(sample, leaves, miss, np.maximum(1, np.ceil(held / (2 * leaf_rows)).astype(np.int64)))


def members(source: Table) -> DataFrame:
    """(h, id) of every usable vector; h stands for all identical ones."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = usable(b.column(1))
            ids = b.column(0).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array([content_key(r) for r in rows], pa.binary()), ids], ["h", "id"])

    return source.rows.select("id", "raw").mapInArrow(keys, "h binary, id string").distinct()


def _fresh(raw: pa.Array, seen: set[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Unit rows and content keys of the usable vectors that this task has not met yet."""
    _, rows = usable(raw)
    keys, fresh = [content_key(r) for r in rows], []
    for i, key in enumerate(keys):
        if key not in seen:
            fresh.append(i)
            seen.add(key)
    if len(seen) > 200_000:
        seen.clear()
    return unit(rows[fresh]), [keys[i] for i in fresh]


def _routed(slot, role, keys: list[bytes], bodies: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(role, pa.int32()), pa.array(keys, pa.binary()), pa.array(bodies, pa.binary())], ["slot", "role", "h", "body"])


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[bytes], np.ndarray]]:
    """(slot, role, keys, vectors) of runs of rows sorted by (slot, role, h); repeated rows come once."""
    last = None
    for b in batches:
        slot, role = b.column(0).to_numpy(), b.column(1).to_numpy()
        keys = b.column(2).to_pylist()
        vecs = np.frombuffer(b"".join(b.column(3).to_pylist()), "<f4").reshape(-1, DIM)
        edge = np.flatnonzero((np.diff(slot) != 0) | (np.diff(role) != 0)) + 1
        for lo, hi in zip([0, *edge], [*edge, len(slot)], strict=True):
            keep = []
            for i in range(lo, hi):
                now = (slot[i], role[i], keys[i])
                if now != last:
                    keep.append(i)
                last = now
            if keep:
                yield int(slot[lo]), int(role[lo]), [keys[i] for i in keep], vecs[keep]


def visit_leaves(source: Table, tree: Tree, kernel: Callable[[], LeafKernel], schema: str, d2: float) -> DataFrame:
    """Route every vector to its leaf and to the leaves it visits at one radius, and run a kernel per leaf.

    Identical vectors are merged on the map side and again as they arrive, sorted, in
    the leaf. Of two leaves only one visits the other, chosen by the parity of their
    numbers, so that the load is even and no pair is compared twice. A leaf's own rows
    come first and stay; visitors stream past them in Arrow batches, so memory follows
    the leaf, not the number of visitors. Visitors of a full leaf are dealt to its
    blocks, each of which gets the leaf's own rows.
    """
    shared = source.rows.sparkSession.sparkContext.broadcast(tree)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        tree = shared.value
        slots, start = tree.slots()
        for b in batches:
            rows, keys = _fresh(b.column(0), seen)
            y = rows @ tree.directions
            own = tree.home(y)
            row, leaf, _ = tree.visits(y, np.full(len(y), d2))
            mine = (own[row] < leaf) == ((own[row] + leaf) % 2 == 0)
            row, leaf = row[mine], leaf[mine]
            blobs = [r.tobytes() for r in rows]
            n = tree.blocks[own]
            home = np.repeat(np.arange(len(own)), n)
            part = np.arange(len(home)) - np.repeat(np.cumsum(n) - n, n)
            dealt = np.array([keys[i][0] for i in row], np.int64) % tree.blocks[leaf]
            who = np.concatenate([home, row])
            slot = slots[np.concatenate([start[own[home]] + part, start[leaf] + dealt])]
            yield _routed(slot, np.repeat([0, 1], [len(home), len(row)]), [keys[i] for i in who], [blobs[i] for i in who])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for slot, role, keys, vecs in _spans(batches):
            if current != slot:
                if state is not None:
                    yield from state.end()
                current, state = slot, kernel()
            keys = np.array(keys, dtype=object)
            state.add(keys, vecs) if role == 0 else (yield from state.visit(keys, vecs))
        if state is not None:
            yield from state.end()

    routed = source.rows.select("raw").mapInArrow(route, ROUTED)
    return routed.repartition(tree.tasks, "slot").sortWithinPartitions("slot", "role", "h").mapInArrow(work, schema)


class LeafKernel:
    """Pairs of a leaf at cosine ``MIN_COS`` or more; subclasses decide what is kept of them."""

    BLOCK = 256

    def __init__(self):
        self.keys: list[np.ndarray] = []
        self.vecs: list[np.ndarray] = []
        self.ready = False

    def add(self, keys: np.ndarray, vecs: np.ndarray) -> None:
        self.keys.append(keys)
        self.vecs.append(vecs)

    def build(self) -> None:
        if not self.ready:
            self.ready = True
            self.own_keys = np.concatenate(self.keys) if self.keys else np.empty(0, dtype=object)
            self.own = np.concatenate(self.vecs) if self.vecs else np.empty((0, DIM), "f4")
            self.inside()

    LEAST = np.float32(MIN_COS - 1e-6)

    def pairs(self, rows: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions (row, other) at ``MIN_COS`` or more, and their cosines."""
        cos = rows @ others.T
        at = np.flatnonzero(cos >= self.LEAST)
        return *np.divmod(at, len(others)), cos.ravel()[at]

    def inside(self) -> None:
        raise NotImplementedError

    def visit(self, keys: np.ndarray, vecs: np.ndarray) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError

    def end(self) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError
