"""Job queue, rewrites and shadows over append-only tables.

Nothing is updated in place: the state of an item is its newest event, and a table
is replaced by writing a new version and moving a one-line pointer.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vektrail.session import numbered, publish_once

OPEN = ("pending", "shadowed")  # fixed values: states of items that still have to be rewritten


def latest(events: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """The newest event of each key; a map-side combined max of a struct."""
    rest = [c for c in events.columns if c not in (*keys, seq)]
    return events.groupBy(*keys).agg(F.max(F.struct(seq, *rest)).alias("_m")).select(*keys, "_m.*")


def enqueue(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What an idempotent insert adds: distinct incoming keys that do not exist yet."""
    return incoming.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti")


def next_batch(items: DataFrame, size: int) -> DataFrame:
    """The open items of highest priority, ties by record; a distributed top-k."""
    return items.where(F.col("state").isin(*OPEN)).orderBy(F.desc_nulls_last("priority"), "record_id").limit(size)


def stats(items: DataFrame, by: Sequence[str]) -> DataFrame:
    """Items, done, failed and remaining of each group, and the completed fraction (0 for none)."""
    count = lambda *s: F.sum(F.col("state").isin(*s).cast("long"))
    got = items.groupBy(*by).agg(F.count("*").alias("total"), count("done").alias("done"), count("failed").alias("failed"), count(*OPEN).alias("remaining"))
    return got.withColumn("fraction", F.round(F.col("done") / F.col("total"), 9))


def mixed_spaces(items: DataFrame, by: Sequence[str]) -> DataFrame:
    """Groups that hold vectors of both spaces: some done, some not."""
    return stats(items, by).where((F.col("done") > 0) & (F.col("done") < F.col("total")))


def page(items: DataFrame, after: str | None, size: int, key: str = "record_id") -> DataFrame:
    """Keyset paging: the next ``size`` rows after a key, in order."""
    rows = items if after is None else items.where(F.col(key) > after)
    return rows.orderBy(key).limit(size)


def upsert(table: DataFrame, changes: DataFrame, key: str = "id", v: str = "v") -> DataFrame:
    """Vectors of existing ids replaced; unknown ids are not inserted and the number of rows stays.

    Of several changes of an id the largest vector in array order is taken, so that the
    result does not depend on row order.
    """
    new = changes.groupBy(key).agg(F.max(v).alias("_new"))
    return table.join(new, key, "left").withColumn(v, F.coalesce("_new", v)).drop("_new").select(*table.columns)


def verify_sample(written: DataFrame, expected: DataFrame, share: float = 0.01, least: int = 5, tolerance: float = 1e-4, key: str = "id", v: str = "v") -> DataFrame:
    """(checked, worst, ok): read-back of exactly max(least, share) expected rows, those of least hash, or of all if there are fewer.

    A row that is missing or of another width counts as infinitely far. Nothing expected is ok.
    """
    n = expected.count()
    want = min(n, max(least, round(n * share)))
    pick = expected.select(key, F.col(v).alias("_e")).orderBy(F.xxhash64(key), key).limit(want)
    far = F.array_max(F.zip_with("_e", v, lambda a, b: F.coalesce(F.abs(a - b), F.lit(float("inf")))))
    got = pick.join(written.select(key, v), key, "left").select(F.coalesce(far, F.lit(float("inf"))).alias("d"))
    return got.agg(F.count("*").alias("checked"), F.max("d").alias("worst")).withColumn("ok", F.coalesce(F.col("worst") <= tolerance, F.lit(True)))


class VersionedTable:
    """A Parquet table of numbered versions; the highest number published is the current one.

    A number is a small file made whole or not at all, which names the folder of its
    rows. Readers never find the table without a version, and of two writers that
    started from the same one only one succeeds.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self) -> tuple[int, str | None]:
        found = numbered(self.spark, f"{self.root}/commits")
        if not found:
            return 0, None
        return found[-1], self.spark.read.text(f"{self.root}/commits/{found[-1]:08d}").first()[0]

    def current(self) -> DataFrame:
        _, version = self._read()
        if version is None:
            raise FileNotFoundError(self.root)
        return self.spark.read.parquet(f"{self.root}/{version}")

    def publish(self, rows: DataFrame) -> str:
        """Write a new version, then publish its number; readers see the old or the new one whole."""
        number, _ = self._read()
        version = f"v-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{version}")
        if not publish_once(self.spark, f"{self.root}/commits/{number + 1:08d}", version.encode()):
            raise RuntimeError(f"version {number + 1} of {self.root} was published by another writer")
        return version

    def roll_back(self, shadow: DataFrame, key: str = "id", v: str = "v") -> str:
        """Put the shadowed vectors back as a new version."""
        return self.publish(upsert(self.current(), shadow, key, v))


def missing_in_cache(keys: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Distinct wanted keys that the cache does not hold."""
    return keys.select(key).where(F.col(key).isNotNull()).distinct().join(cache.select(key), key, "left_anti")


def cache_stats(keys: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """(lookups, distinct_keys, hits, misses, hit_rate) of a batch of look-ups."""
    known = cache.select(key).distinct().withColumn("_hit", F.lit(1))
    got = keys.join(known, key, "left").agg(F.count("*").alias("lookups"), F.countDistinct(key).alias("distinct_keys"), F.count("_hit").alias("hits"))
    return got.withColumn("misses", F.col("lookups") - F.col("hits")).withColumn("hit_rate", F.round(F.col("hits") / F.col("lookups"), 9))


def replay_hits(log: DataFrame, doc: str, order: Sequence[str]) -> DataFrame:
    """(lookups, hits) of an unbounded cache over an ordered log: all but the first look-up of a document."""
    first = log.withColumn("_rn", F.row_number().over(W.partitionBy(doc).orderBy(*order)))
    return first.agg(F.count("*").alias("lookups"), F.sum((F.col("_rn") > 1).cast("long")).alias("hits"))


def cached_encode(texts: DataFrame, cache: DataFrame, encode, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Read-through cache: (rows with vectors, new cache). Each missing key is encoded once; ``encode`` maps (key, text) to (key, v)."""
    missing = texts.dropDuplicates([key]).join(cache.select(key), key, "left_anti")
    full = cache.select(key, "v").unionByName(encode(missing.select(key, "text")).select(key, "v"))
    return texts.join(full, key, "left"), full
