"""Blind alignment of two spaces without pairs, and how much it reveals.

Anchors: in each of 30 rounds the k-means centres of both sides are matched by their
similarities (2-opt on the quadratic assignment); the matched centres of all rounds
together make a relative representation, in which each source row gets the mean of its
nearest targets. The map fitted to these pseudo-pairs is refined by 100 nearest-neighbour
rounds and once by 500 clusters.

Clustering, matching and the source rows of a round use samples of at most ``SAMPLE``
rows on the driver. Targets up to that many are searched there too; more are searched
by the distributed block kernel.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vektrail.functions import vec
from vektrail.operators.adapters import Adapter
from vektrail.operators.knn import DIGITS, top_k
from vektrail.operators.sampling import reservoir
from vektrail.session import staged

SAMPLE = 10_000
ROUNDS, CENTRES, RESTARTS, NEIGHBOURS = 30, 20, 30, 50  # anchors
STEPS, CLUSTERS, BLEND = 100, 500, 0.5  # refinement
SEEDS, SPREAD_LIMIT = (0, 1, 2), 0.10


def mean_vector(rows: DataFrame, dim: int) -> list[float]:
    return vec.average(rows.withColumn("_g", F.lit(1)), ["_g"], "v", "m", dim).first().m


def centred_units(rows: DataFrame, mean: Sequence[float]) -> DataFrame:
    """Vectors minus ``mean``, as unit vectors."""
    m = F.array(*[F.lit(float(x)) for x in mean])
    return rows.withColumn("v", vec.l2_normalize(F.zip_with(vec.doubles(F.col("v")), m, lambda a, b: a - b)))


def identification(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """(query_id, place): 1 + targets that score strictly higher than the query's own twin (ties do not hurt).

    The query set is broadcast in blocks to the targets; counts are combined before they move.
    """
    q = queries.select(F.col("id").alias("query_id"), F.col("v").alias("qv"))
    own = q.join(targets.select(F.col("id").alias("query_id"), F.col("v").alias("tv")), "query_id").select("query_id", F.round(vec.dot(F.col("qv"), F.col("tv")), DIGITS).alias("own"), "qv").toPandas()
    shared = targets.sparkSession.sparkContext.broadcast((own.query_id.to_numpy(), np.stack(own.qv) if len(own) else np.empty((0, 1)), own.own.to_numpy()))

    def count(batches):
        import pyarrow as pa

        ids, qv, truth = shared.value
        for b in batches:
            if b.num_rows and len(ids):
                d = np.stack([np.asarray(x, "f8") for x in b.column(0).to_pylist()])
                higher = (np.round(qv @ d.T, DIGITS) > truth[:, None]).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(higher, pa.int64())], ["query_id", "c"])

    return targets.select(vec.doubles(F.col("v")).alias("v")).mapInArrow(count, "query_id long, c long").groupBy("query_id").agg((F.sum("c") + 1).alias("place"))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _rotation(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    u, _, vt = np.linalg.svd(x.T @ y)
    return u @ vt


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared, without the norm of x."""
    return (c * c).sum(1) - 2 * (x @ c.T)


def k_means(x: np.ndarray, k: int, seed: int = 0, init: np.ndarray | None = None, most: int = 300, tolerance: float = 1e-4) -> np.ndarray:
    """Centres of ``x``, from k-means++ or ``init``. A centre without rows moves to the row farthest from its own."""
    rng, norms = np.random.default_rng(seed), (x * x).sum(1)
    if init is None:
        c = x[[rng.integers(len(x))]]
        near = np.maximum(norms + _distances(x, c)[:, 0], 0)
        while len(c) < k:
            total = near.sum()
            at = rng.choice(len(x), p=near / total) if total > 0 else rng.integers(len(x))
            c = np.vstack([c, x[at]])
            near = np.minimum(near, np.maximum(norms + _distances(x, c[-1:])[:, 0], 0))
    else:
        c = np.array(init, "f8")
    enough = tolerance * x.var(0).mean()
    for _ in range(most):
        d = _distances(x, c)
        own = d.argmin(1)
        far = np.argsort(-(norms + d[np.arange(len(x)), own]), kind="stable")
        count = np.bincount(own, minlength=len(c))
        order = np.argsort(own, kind="stable")
        new = c.copy()
        held = np.flatnonzero(count)
        new[held] = np.add.reduceat(x[order], np.concatenate(([0], np.cumsum(count[held])[:-1]))) / count[held, None]
        empty = np.flatnonzero(count == 0)
        new[empty] = x[far[: len(empty)]]
        moved = ((new - c) ** 2).sum()
        c = new
        if moved <= enough:
            break
    return c


def match(a: np.ndarray, b: np.ndarray, restarts: int = RESTARTS, seed: int = 0) -> tuple[np.ndarray, float]:
    """Permutation p with a[i] ~ b[p[i]] by 2-opt on the agreement of two symmetric similarity matrices; best of the restarts.

    The gain of every swap is found at once; the best swap is made until none helps.
    """
    rng = np.random.default_rng(seed)
    n, best, kept = len(a), -np.inf, np.arange(len(a))
    da = np.diag(a)
    for _ in range(restarts):
        p = rng.permutation(n)
        while True:
            q = b[np.ix_(p, p)]
            m, dq = a @ q, np.diag(q)
            dm = np.diag(m)
            # sum over k of (a[i, k] - a[j, k]) * (q[j, k] - q[i, k]), then without k = i and k = j
            gain = m + m.T - dm[:, None] - dm[None, :] - (da[:, None] - a) * (q - dq[:, None]) - (a - da[None, :]) * (dq[None, :] - q)
            gain = 2 * gain + (da[:, None] - da[None, :]) * (dq[None, :] - dq[:, None])
            i, j = divmod(int(gain.argmax()), n)
            if gain[i, j] <= 1e-12 * max(1.0, abs(float((a * q).sum()))):
                break
            p[i], p[j] = p[j], p[i]
        value = (a * b[np.ix_(p, p)]).sum()
        if value > best:
            best, kept = value, p
    return kept, float(best / max(1e-12, np.linalg.norm(a) * np.linalg.norm(b)))


def _gram(c: np.ndarray) -> np.ndarray:
    c = c - c.mean(0)
    return c @ c.T


class Side:
    """The unit vectors (id, v) of one side; up to ``most`` rows are held on the driver."""

    def __init__(self, rows: DataFrame, dim: int, most: int | None = None):
        self.rows, self.dim, self.most = rows, dim, SAMPLE if most is None else most
        self.count = rows.count()
        self.local = self._fetched(rows) if self.count <= self.most else None

    def _fetched(self, rows: DataFrame) -> np.ndarray:
        got = rows.select("id", "v").toPandas().sort_values("id")
        return np.stack(got.v).astype("f8") if len(got) else np.empty((0, self.dim))

    def sample(self, seed: int) -> np.ndarray:
        return self.local if self.local is not None else self._fetched(reservoir(self.rows, self.most, seed))

    def matched_mean(self, x: np.ndarray, k: int, relative: np.ndarray | None = None) -> np.ndarray:
        """Mean of the k rows nearest to each row of ``x``; with ``relative`` they are sought by their products with these anchors."""
        if self.local is not None:
            where = self.local if relative is None else unit(self.local @ relative.T)
            k = min(k, len(where))
            out = []
            for lo in range(0, len(x), 1_000):
                scores = x[lo : lo + 1_000] @ where.T
                out.append(self.local[np.argpartition(-scores, k - 1, axis=1)[:, :k]].mean(1))
            return np.concatenate(out)
        spark = self.rows.sparkSession
        queries = spark.createDataFrame([(i, [float(e) for e in row]) for i, row in enumerate(x)], "id long, v array<double>")
        docs = self.rows.select("id", "v")
        if relative is not None:
            docs = docs.withColumn("v", Adapter("relative", relative.T, np.zeros(len(relative)), len(relative), relative.size).udf(normalize=True)(F.col("v")))
        near = top_k(queries, docs, k).join(self.rows.select(F.col("id").alias("doc_id"), F.col("v").alias("dv")), "doc_id")
        return np.stack(vec.average(near, ["query_id"], "dv", "v", self.dim).toPandas().sort_values("query_id").v)


def anchors(source: Side, target: Side, seed: int = 0, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Matched centres of both sides, one set per round."""
    k = max(2, min(CENTRES, min(source.count, target.count) // 2))
    of_source, of_target = [], []
    for n in range(rounds):
        at = seed * 1_000 + n
        a, b = k_means(source.sample(at), k, at), k_means(target.sample(at + 500), k, at + 500)
        p, _ = match(_gram(a), _gram(b), seed=at)
        of_source.append(a)
        of_target.append(b[p])
    return unit(np.vstack(of_source)), unit(np.vstack(of_target))


def align(source: Side, target: Side, seed: int = 0, rounds: int = ROUNDS, steps: int = STEPS) -> np.ndarray:
    """A map source -> target fitted without pairs; the blend lets it leave the rotations a little."""
    of_source, of_target = anchors(source, target, seed, rounds)
    x = source.sample(seed)
    w = _rotation(x, target.matched_mean(unit(x @ of_source.T), NEIGHBOURS, of_target))
    for n in range(steps):
        x = source.sample(seed * 1_000 + n)
        w = (1 - BLEND) * w + BLEND * _rotation(x, target.matched_mean(unit(x @ w), NEIGHBOURS))
    k = max(2, min(CLUSTERS, min(source.count, target.count) // 8))
    of_source = k_means(source.sample(seed), k, seed * 2_000)
    of_target = k_means(target.sample(seed), k, init=of_source @ w)
    return (1 - BLEND) * w + BLEND * _rotation(of_source, of_target)


def split(source: DataFrame, target: DataFrame) -> tuple[Column, DataFrame, DataFrame]:
    """The condition of the held fifth, and of the other rows two parts with no id in common and unequal in number: source's and target's."""
    held = F.pmod(F.xxhash64("id"), F.lit(5)) == 0
    place = F.pmod(F.xxhash64("id", F.lit("half")), F.lit(1_000))
    for cut in range(499, 0, -1):
        a, b = source.where(~held & (place >= cut)), target.where(~held & (place < cut))
        if a.count() != b.count():
            break
    return held, a, b


def measure(source: DataFrame, target: DataFrame, seeds: Sequence[int] = SEEDS) -> DataFrame:
    """(seed, identified, mean_place, rows, best, unstable): blind identification of a hashed fifth of the rows, per seed.

    The measure is the row with ``best``; ``unstable`` says that the seeds differ by more than ``SPREAD_LIMIT``.
    """
    spark = source.sparkSession
    dim = max(rows.select(F.size("v")).first()[0] for rows in (source, target))
    source, target = (rows.select("id", vec.pad_or_truncate(F.col("v"), dim).alias("v")) for rows in (source, target))
    held, a, b = split(source, target)
    mean_a, mean_b = mean_vector(a, dim), mean_vector(b, dim)
    fit_a, fit_b = (Side(staged(centred_units(rows, mean), name), dim) for rows, mean, name in ((a, mean_a, "source"), (b, mean_b, "target")))
    held_a, held_b = staged(centred_units(source.where(held), mean_a), "held"), staged(centred_units(target.where(held), mean_b), "held")
    out = []
    for seed in seeds:
        blind = Adapter("blind", align(fit_a, fit_b, seed), np.zeros(dim), dim, dim * dim)
        mapped = staged(held_a.withColumn("v", blind.udf(normalize=True)(F.col("v"))), "mapped")
        got = identification(mapped, held_b).agg(F.avg((F.col("place") == 1).cast("double")).alias("hit"), F.avg("place").alias("place"), F.count("*").alias("n")).first()
        out.append((seed, got.hit, got.place, got.n))
    hits = [hit or 0.0 for _, hit, _, _ in out]
    top = hits.index(max(hits))
    return spark.createDataFrame([(*row, n == top, max(hits) - min(hits) > SPREAD_LIMIT) for n, row in enumerate(out)], "seed int, identified double, mean_place double, rows long, best boolean, unstable boolean")
