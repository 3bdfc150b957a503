"""Reading level of each document.

Method: one smoothed unigram language model per level, trained on the labelled
documents, with the share of a level among them as its prior; words that no label has
count by the smoothing. Every sentence has a posterior over the levels. The posterior
of a document is the mean of those of its sentences, that is of a sentence drawn from
it, so that one long sentence in another register does not decide. The document gets
the level of highest posterior.

Whether a text is English is decided by a model too: character trigrams of each
sentence, English against every other language of ``lang``. It is trained on a bounded
sample of the corpus by its own, partly wrong, lang labels: first by the labels, then
once more by what the first model says of each sentence. A sentence that is much less
likely under the English model than English sentences are is in none of the languages.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vektrail.session import table

MAX_LABELS = 20_000  # labelled documents the models are trained on, at most
SMOOTHING = 0.5
LEAST_WORDS = 40
WORD = re.compile(r"[^\W_]+")
LETTERS = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"(?<=[.!?;])\s+|\n+")
OTHER_KINDS = ("code_chunks", "query_log")
MAX_TONGUE_DOCS = 1_500  # documents of each language the trigram model is trained on, at most
LEAST_TONGUE_DOCS = 3  # of a language, to have a model
SLOTS = 1 << 15  # hashed trigrams
FAR = 2.0  # log likelihood per trigram by which a sentence may lie under the mean of English ones
SHORT = 3  # words; shorter sentences count only in texts that have no longer one


def _pieces(text: str) -> list[list[str]]:
    out = []
    for part in SENTENCE.split(text.lower()):
        words = LETTERS.findall(part)
        if words:
            out.append(words)
    return out


def trigrams(pieces: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character trigrams of all sentences of a text, and where each sentence starts."""
    parts = ["  " + " ".join(p) for p in pieces]
    c = np.frombuffer("".join([*parts, "  "]).encode("utf-32-le", "replace"), "<u4").astype(np.uint32)
    h = (c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA6B)) ^ (c[2:] * np.uint32(0xC2B2AE35))
    sizes = np.array([len(p) for p in parts], np.int64)
    return ((h ^ (h >> np.uint32(15))) % np.uint32(SLOTS)).astype(np.int64), np.cumsum(sizes) - sizes


@dataclass(frozen=True)
class Tongues:
    """Log likelihoods of trigrams by language, English first, and the mean of a trigram in English sentences."""

    names: tuple[str, ...]
    table: np.ndarray  # trigram by language
    mean: float

    def best(self, pieces: list[list[str]]) -> np.ndarray:
        """Position of the most likely language of each sentence; -1 if it is too far even from English."""
        slots, starts = trigrams(pieces)
        got = np.add.reduceat(self.table[slots], starts, axis=0) / np.diff([*starts, len(slots)])[:, None]
        top = got.argmax(1)
        return np.where((top == 0) & (got[:, 0] < self.mean - FAR), -1, top)

    def is_english(self, pieces: list[list[str]]) -> bool:
        """More than half of the words stand in English sentences."""
        words = np.array([len(p) for p in pieces])
        return bool(len(pieces)) and 2 * words[self.best(pieces) == 0].sum() > words.sum()


def train_tongues(docs: DataFrame, most: int = MAX_TONGUE_DOCS) -> Tongues | None:
    """The trigram models of English and of every other language that ``lang`` names often enough; None without English.

    docs has doc_id, lang and text. The first two letters of lang, trimmed and in lower
    case, name the language. At most ``most`` documents of each, in hash order.
    """
    named = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.regexp_extract(F.lower(F.trim("lang")), "^([a-z]{2})($|[-_])", 1).alias("tongue")).where("tongue <> ''")
    first = W.partitionBy("tongue").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = named.withColumn("place", F.row_number().over(first)).where(F.col("place") <= most).select("doc_id", "tongue").distinct()
    sizes = {r.tongue: r["count"] for r in picked.groupBy("tongue").count().collect()}  # one row per language
    names = ("en", *sorted(k for k, n in sizes.items() if k != "en" and n >= LEAST_TONGUE_DOCS))
    if not sizes.get("en"):
        return None
    rows = docs.select("doc_id", "text").join(F.broadcast(picked.where(F.col("tongue").isin(*names))), "doc_id").select("text", "tongue")  # at most ``most`` of each

    def counted(model: Tongues | None) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = np.zeros((len(names), SLOTS))
            like = np.zeros(2)  # of English sentences: trigrams and the sum of their log likelihoods
            for b in batches:
                met: list[list[np.ndarray]] = [[] for _ in names]
                for raw, tongue in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist(), strict=True):
                    pieces = _pieces(raw.decode("utf-8", "replace"))
                    if not pieces:
                        continue
                    slots, starts = trigrams(pieces)
                    if model is None:
                        met[names.index(tongue)].append(slots)
                        continue
                    of = np.repeat(model.best(pieces), np.diff([*starts, len(slots)]))
                    for k in range(len(names)):
                        met[k].append(slots[of == k])
                    like += (of == 0).sum(), model.table[slots[of == 0], 0].sum()
                for k, some in enumerate(met):
                    if some:
                        seen[k] += np.bincount(np.concatenate(some), minlength=SLOTS)
            for i, row in enumerate([*seen, like]):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([row.tobytes()], pa.binary())], ["i", "counts"])

        out = [np.zeros(SLOTS) for _ in names] + [np.zeros(2)]
        # one row per language and task: a table of fixed size
        for r in rows.mapInArrow(run, "i int, counts binary").toLocalIterator():
            out[r.i] = out[r.i] + np.frombuffer(r.counts)
        return np.stack(out[:-1]), out[-1]

    def model_of(counts: np.ndarray, mean: float) -> Tongues:
        return Tongues(names, np.log((counts + SMOOTHING) / (counts.sum(1, keepdims=True) + SMOOTHING * SLOTS)).astype("f4").T.copy(), mean)

    model = model_of(counted(None)[0], -math.inf)
    counts, (n, total) = counted(model)
    return model_of(counts, total / max(1.0, n))


@dataclass(frozen=True)
class Levels:
    """Log likelihoods by word and level; its size follows the labelled sample's vocabulary."""

    names: tuple[str, ...]
    words: dict[str, tuple[float, ...]]
    prior: tuple[float, ...]
    unseen: tuple[float, ...]

    def posterior(self, pieces: list[list[str]]) -> np.ndarray:
        """Mean posterior of the sentences of a text."""
        sizes = np.array([len(p) for p in pieces])
        x = np.add.reduceat(np.array([self.words.get(w, self.unseen) for p in pieces for w in p]), np.cumsum(sizes) - sizes, axis=0) + np.array(self.prior)
        x = np.exp(x - x.max(1, keepdims=True))
        x /= x.sum(1, keepdims=True)
        return x[sizes >= SHORT].mean(0) if (sizes >= SHORT).any() else x.mean(0)

    def level(self, pieces: list[list[str]]) -> str:
        return self.names[int(self.posterior(pieces).argmax())]


def train(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, smoothing: float = SMOOTHING) -> Levels:
    """Unigram models from at most ``max_labels`` labelled documents, taken in hash order.

    Words are counted by Spark; counts per (level, word) reach the driver. A document
    with two different labels is not used, and repeated rows count once.
    """
    one = labels.where(F.col("doc_id").isNotNull() & F.col("band").isNotNull()).groupBy("doc_id").agg(F.min("band").alias("band"), F.max("band").alias("other")).where("band = other")
    # at most max_labels rows of two short fields, so the texts need not move
    one = one.select("doc_id", "band").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    found = docs.select("doc_id", "text").join(F.broadcast(one), "doc_id")
    prior = {r.band: r["count"] for r in found.groupBy("band").count().collect()}  # one row per level
    words = found.select("band", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{M}]+"), 0)).alias("word"))
    counts = words.groupBy("band", "word").count().collect()
    names = tuple(sorted({r.band for r in counts}))
    total = {n: sum(r["count"] for r in counts if r.band == n) for n in names}
    seen: dict[str, dict[str, int]] = {}
    for r in counts:
        seen.setdefault(r.word, {})[r.band] = r["count"]
    size = len(seen) + 1
    table_ = {w: tuple(math.log((c.get(n, 0) + smoothing) / (total[n] + smoothing * size)) for n in names) for w, c in seen.items()}
    return Levels(names, table_, tuple(math.log(prior[n] / sum(prior.values())) for n in names), tuple(math.log(smoothing / (total[n] + smoothing * size)) for n in names))


def levelled(docs: DataFrame, model: Levels, tongues: Tongues | None, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, band) of each mainly English document of at least ``least_words`` words.

    Null, empty and short texts and other languages have no row; without any label,
    or without a model of English, there are no rows. One narrow pass over whole texts.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model, tongues))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, tongues = shared.value
        for b in batches:
            ids, bands = [], []
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                text = raw.decode("utf-8", "replace") if raw else ""
                words = WORD.findall(text.lower())
                if not levels.names or tongues is None or len(words) < least_words:
                    continue
                pieces = _pieces(text)
                if tongues.is_english(pieces):
                    ids.append(doc)
                    bands.append(levels.level(pieces))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(bands, pa.string())], ["doc_id", "band"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, band string")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, band) of the English prose documents of known sources."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    model = train(docs, table(spark, sf_dir, "reading_labels"))
    kind = F.lower(F.trim("source"))
    prose = docs.where(F.col("source").isNotNull() & (kind != "") & ~kind.isin(*OTHER_KINDS))
    return levelled(prose, model, train_tongues(docs))
