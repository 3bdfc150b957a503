"""Maps between two embedding spaces, fitted from one distributed moment aggregate.

Rows are vectors and a map is x R + c. All closed forms follow from n, the sums and
the three product matrices of the pairs, so one pass over the pairs fits every
candidate; the driver holds d x d numbers whatever the number of pairs.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST_PAIRS = 32
TIE = 0.005  # scores this close are equal; then the smaller map wins


@dataclass
class Moments:
    """n, sums, products and sum of (|a|^2 - |b|^2)^2 of the pairs (a, b)."""

    n: int
    a: np.ndarray
    b: np.ndarray
    aa: np.ndarray
    ab: np.ndarray
    bb: np.ndarray
    gap: float

    @classmethod
    def of(cls, pairs: DataFrame, src: str = "src", dst: str = "dst", least: int = LEAST_PAIRS) -> Moments:
        """One pass; partial sums per partition are combined by Spark. Not finite or missing pairs are an error."""
        sizes = pairs.agg(F.count("*").alias("n"), F.min(F.size(src)).alias("s0"), F.max(F.size(src)).alias("s1"), F.min(F.size(dst)).alias("d0"), F.max(F.size(dst)).alias("d1")).first()
        if sizes.n < least or sizes.s0 != sizes.s1 or sizes.d0 != sizes.d1 or sizes.s0 < 1:
            raise ValueError(f"{sizes.n} pairs of widths {sizes.s0}-{sizes.s1} and {sizes.d0}-{sizes.d1}: at least {least} of equal width are needed")
        p, q = sizes.s0, sizes.d0

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.stack([np.asarray(v, "f8") for v in batch.column(0).to_pylist()])
                y = np.stack([np.asarray(v, "f8") for v in batch.column(1).to_pylist()])
                gap = (((x * x).sum(1) - (y * y).sum(1)) ** 2).sum()
                flat = np.concatenate([[len(x)], x.sum(0), y.sum(0), (x.T @ x).ravel(), (x.T @ y).ravel(), (y.T @ y).ravel(), [gap]])
                total = flat if total is None else total + flat
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total, pa.float64())], ["i", "x"])

        rows = pairs.select(src, dst).mapInArrow(part, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas().sort_values("i")
        flat = rows.x.to_numpy()
        if not np.isfinite(flat).all():
            raise ValueError("the pairs hold numbers that are not finite")
        cuts = np.cumsum([1, p, q, p * p, p * q, q * q])
        n, a, b, aa, ab, bb, gap = np.split(flat, cuts)
        return cls(int(n[0]), a, b, aa.reshape(p, p), ab.reshape(p, q), bb.reshape(q, q), float(gap[0]))

    def padded(self) -> Moments:
        """Both sides filled with zeros to the larger width."""
        d = max(len(self.a), len(self.b))
        pa_, pb = d - len(self.a), d - len(self.b)
        return Moments(self.n, np.pad(self.a, (0, pa_)), np.pad(self.b, (0, pb)), np.pad(self.aa, ((0, pa_),) * 2), np.pad(self.ab, ((0, pa_), (0, pb))), np.pad(self.bb, ((0, pb),) * 2), self.gap)

    def geometry(self) -> tuple[float, float, float | None]:
        """(delta, bound, cosine floor): rms difference of the two Gram matrices off the diagonal and what follows."""
        d = max(len(self.a), len(self.b))
        square = (self.aa**2).sum() - 2 * (self.ab**2).sum() + (self.bb**2).sum() - self.gap
        delta = math.sqrt(max(0.0, square) / (self.n * (self.n - 1)))
        bound = math.sqrt(2 * d) * delta
        return delta, bound, 1 - bound / 2 if bound < 2 else None


@dataclass
class Adapter:
    """x -> pad(x) W + c, optionally through a residual network, cut to ``dim`` elements."""

    kind: str
    w: np.ndarray
    c: np.ndarray
    dim: int
    n_params: int
    extra: dict[str, np.ndarray] = field(default_factory=dict)

    def apply(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, "f8")
        if x.shape[1] < len(self.w):
            x = np.pad(x, ((0, 0), (0, len(self.w) - x.shape[1])))
        y = x[:, : len(self.w)] @ self.w + self.c
        if "w1" in self.extra:
            y = y + gelu(x @ self.extra["w1"] + self.extra["b1"]) @ self.extra["w2"] + self.extra["b2"]
        return y[:, : self.dim]

    def udf(self, normalize: bool = False) -> Callable:
        """Arrow UDF of the map; the weights travel with it once per executor's Python."""
        me = self

        @F.pandas_udf("array<double>")
        def mapped(v: pd.Series) -> pd.Series:
            out = pd.Series([None] * len(v), dtype=object)
            at = [i for i, x in enumerate(v) if x is not None]
            if at:
                y = me.apply(np.stack([np.asarray(v.iloc[i], "f8") for i in at]))
                if normalize:
                    y = y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
                for i, row in zip(at, y, strict=True):
                    out.iloc[i] = row
            return out

        return mapped

    def save(self, spark: SparkSession, path: str, calibration: dict | None = None, evaluation: dict | None = None) -> None:
        """A directory: weights as Parquet (name, shape, values) and a JSON manifest."""
        parts = {"w": self.w, "c": self.c, **self.extra}
        rows = [(k, [int(s) for s in v.shape], [float(x) for x in v.ravel()]) for k, v in parts.items()]
        spark.createDataFrame(rows, "name string, shape array<int>, values array<double>").coalesce(1).write.parquet(f"{path}/weights")
        head = {"kind": self.kind, "dim": self.dim, "n_params": self.n_params, "calibration": calibration, "evaluation": evaluation}
        spark.createDataFrame([(json.dumps(head, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/manifest")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Adapter:
        head = json.loads(spark.read.text(f"{path}/manifest").first()[0])
        parts = {r.name: np.array(r["values"]).reshape(r.shape) for r in spark.read.parquet(f"{path}/weights").collect()}
        return cls(head["kind"], parts.pop("w"), parts.pop("c"), head["dim"], head["n_params"], parts)


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + np.vectorize(math.erf)(x / math.sqrt(2)))


def identity(m: Moments) -> Adapter:
    d, q = max(len(m.a), len(m.b)), len(m.b)
    return Adapter("identity", np.eye(d), np.zeros(d), q, 0)


def procrustes(m: Moments, centered: bool = True, scale: bool = False) -> Adapter:
    """The orthogonal map (reflections allowed) closest in least squares; centred on both means by default."""
    q = len(m.b)
    m = m.padded()
    a, b = (m.a / m.n, m.b / m.n) if centered else (np.zeros_like(m.a), np.zeros_like(m.b))
    cross = m.ab - m.n * np.outer(a, b)
    u, s, vt = np.linalg.svd(cross)
    r = u @ vt
    if scale:
        r = r * (s.sum() / max(np.trace(m.aa - m.n * np.outer(a, a)), 1e-12))
    d = len(m.a)
    return Adapter("procrustes_centered" if centered else "procrustes", r, b - a @ r, q, d * d + (2 * d if centered else 0))


def linear(m: Moments, ridge: float = 1e-3) -> Adapter:
    """Ridge regression with a bias; the penalty is ``ridge`` times the mean of the centred Gram's diagonal."""
    a, b = m.a / m.n, m.b / m.n
    gram = m.aa - m.n * np.outer(a, a)
    d = len(a)
    w = np.linalg.solve(gram + ridge * np.trace(gram) / d * np.eye(d), m.ab - m.n * np.outer(a, b))
    return Adapter("linear", w, b - a @ w, len(b), w.size + len(b))


def low_rank(m: Moments, rank: int | None = None) -> Adapter:
    """Truncated ridge map; default rank min(d, max(32, round(d / 4)))."""
    full = linear(m)
    d = min(full.w.shape)
    rank = rank or min(d, max(32, round(d / 4)))
    u, s, vt = np.linalg.svd(full.w, full_matrices=False)
    w = (u[:, :rank] * s[:rank]) @ vt[:rank]
    return Adapter("low_rank_affine", w, m.b / m.n - m.a / m.n @ w, len(m.b), rank * sum(full.w.shape) + len(m.b))


def scaled(base: Adapter, m: Moments) -> Adapter:
    """``base`` with one factor per output dimension, sum(p t) / sum(p p), from the same moments."""
    p = m if len(base.w) == len(m.a) else m.padded()
    r, c = base.w[:, : base.dim], base.c[: base.dim]
    ab, b = p.ab[:, : base.dim], p.b[: base.dim]
    top = (r.T @ ab).diagonal() + c * b
    low = (r.T @ p.aa @ r).diagonal() + 2 * c * (r.T @ p.a) + p.n * c * c
    f = np.where(low / p.n > 1e-12, top / np.maximum(low, 1e-300), 1.0)
    return Adapter(base.kind + "+dsm", r * f, c * f, base.dim, base.n_params + base.dim)


def residual_mlp(pairs: DataFrame, m: Moments, hidden: int = 256, epochs: int = 60, patience: int = 8, sample: int = 4_000, seed: int = 0) -> Adapter:
    """Ridge map plus a GELU network trained by Adam on at most ``sample`` pairs (in hash order).

    The last layer starts at zero, so training starts from the ridge map; the best
    epoch on a tenth of the pairs is kept.
    """
    base = linear(m)
    rows = pairs.select("src", "dst").orderBy(F.xxhash64("src")).limit(sample).toPandas()
    x, y = np.stack(rows.src).astype("f8"), np.stack(rows.dst).astype("f8")
    target = y - base.apply(x)
    rng = np.random.default_rng(seed)
    d, q = x.shape[1], y.shape[1]
    p = {"w1": rng.standard_normal((d, hidden)) / math.sqrt(d), "b1": np.zeros(hidden), "w2": np.zeros((hidden, q)), "b2": np.zeros(q)}
    first, second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    held = max(1, len(x) // 10)
    tx, tt, vx, vt = x[held:], target[held:], x[:held], target[:held]
    best, kept, wait, step = math.inf, None, 0, 0
    for _ in range(epochs):
        order = rng.permutation(len(tx))
        for lo in range(0, len(order), 256):
            at = order[lo : lo + 256]
            z = tx[at] @ p["w1"] + p["b1"]
            cdf = 0.5 * (1 + np.vectorize(math.erf)(z / math.sqrt(2)))
            h = z * cdf
            err = (h @ p["w2"] + p["b2"] - tt[at]) * (2 / len(at))
            back = (err @ p["w2"].T) * (cdf + z * np.exp(-z * z / 2) / math.sqrt(2 * math.pi))
            grad = {"w1": tx[at].T @ back, "b1": back.sum(0), "w2": h.T @ err, "b2": err.sum(0)}
            step += 1
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] = p[k] - 1e-3 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        loss = float(((gelu(vx @ p["w1"] + p["b1"]) @ p["w2"] + p["b2"] - vt) ** 2).mean())
        if loss < best - 1e-9:
            best, kept, wait = loss, {k: v.copy() for k, v in p.items()}, 0
        else:
            wait += 1
            if wait >= patience:
                break
    return Adapter("residual_mlp", base.w, base.c, q, base.n_params + sum(v.size for v in p.values()), kept or p)


FITS: dict[str, Callable[[Moments], Adapter]] = {
    "identity": identity,
    "procrustes": lambda m: procrustes(m, centered=False),
    "procrustes_centered": procrustes,
    "linear": linear,
    "low_rank_affine": low_rank,
}


def fit_candidates(m: Moments, kinds: list[str]) -> list[Adapter]:
    """All named maps from one moment row; ``+dsm`` adds the per-dimension scale, unknown names are skipped."""
    out = []
    for kind in kinds:
        base, _, tail = kind.partition("+")
        if base in FITS and tail in ("", "dsm"):
            fitted = FITS[base](m)
            out.append(scaled(fitted, m) if tail else fitted)
    return out


def chained(*maps: Adapter) -> Callable[[np.ndarray], np.ndarray]:
    """The maps one after the other."""

    def run(x: np.ndarray) -> np.ndarray:
        for a in maps:
            x = a.apply(x)
        return x

    return run


def select_best(scores: DataFrame, tie: float = TIE) -> DataFrame:
    """Of (name, score, n_params) the best; among scores within ``tie`` the fewest parameters, then the name."""
    top = scores.agg(F.max("score").alias("top"))
    return scores.crossJoin(F.broadcast(top)).where(F.col("score") >= F.col("top") - tie).drop("top").orderBy("n_params", F.desc("score"), "name").limit(1)  # top is one row


def csls_bias(docs: DataFrame, mapped: DataFrame, k: int = 10) -> DataFrame:
    """(id, bias): minus half the mean similarity of a document to its k nearest mapped queries."""
    from vektrail.operators.knn import top_k

    near = top_k(docs, mapped, k)
    return near.groupBy(F.col("query_id").alias("id")).agg((F.avg("score") * -0.5).alias("bias"))


@dataclass(frozen=True)
class Calibrator:
    """Monotone score map: linear between knots, flat outside."""

    x: tuple[float, ...]
    y: tuple[float, ...]

    @classmethod
    def fit(cls, pairs: DataFrame, score: str = "score", target: str = "target") -> Calibrator:
        from pyspark.ml.regression import IsotonicRegression

        data = pairs.where(F.col(score).isNotNull() & F.col(target).isNotNull()).select(F.col(score).alias("features"), F.col(target).alias("label"), F.lit(1.0).alias("weight"))
        model = IsotonicRegression(weightCol="weight").fit(data)
        return cls(tuple(map(float, model.boundaries)), tuple(map(float, model.predictions)))

    def column(self, score):
        """Interpolation as a JVM expression over the knots."""
        xs, ys = F.array(*[F.lit(v) for v in self.x]), F.array(*[F.lit(v) for v in self.y])
        below = F.size(F.filter(xs, lambda v: v <= score))
        x0, x1 = F.element_at(xs, below), F.element_at(xs, below + 1)
        y0, y1 = F.element_at(ys, below), F.element_at(ys, below + 1)
        return F.when(score <= self.x[0], self.y[0]).when(score >= self.x[-1], self.y[-1]).otherwise(y0 + (y1 - y0) * (score - x0) / (x1 - x0))


def held_out_gain(pairs: DataFrame, current: Adapter, candidate: Adapter) -> DataFrame:
    """(now, new): mean cosine of mapped and target vectors under two maps, on the same pairs."""
    from vektrail.functions.vec import cosine

    return pairs.select(cosine(current.udf()(F.col("src")), F.col("dst")).alias("a"), cosine(candidate.udf()(F.col("src")), F.col("dst")).alias("b")).agg(F.avg("a").alias("now"), F.avg("b").alias("new"))
