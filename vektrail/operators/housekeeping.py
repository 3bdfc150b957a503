"""Budgets, retention, a single-writer lock and replays of a bounded cache."""

from __future__ import annotations

import contextlib
import re
from collections import OrderedDict
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vektrail.session import filesystem

# fixed values: days that files of a class are kept, copies of backups kept, classes never removed
RETENTION_DAYS = {"reports": 90, "cache": 30, "tmp": 1}
KEEP_BACKUPS = 3
PROTECTED = ("shadow", "audit", "state")
RECORDS_PER_SECOND, WATT_HOURS_PER_RECORD = 40.0, 1e-4  # fixed values: used when nothing was measured

_UNITS = {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def memory_size(text: str) -> int:
    """Bytes of ``512``, ``64k``, ``1.5 GB`` and the like."""
    got = re.fullmatch(r"\s*([0-9]+(?:\.[0-9]+)?)\s*([kmgt]?)(?:i?b)?\s*", text.lower())
    if not got:
        raise ValueError(f"not a size: {text!r}")
    return int(float(got[1]) * _UNITS[got[2]])


def rewrite_budget(n: Column, dim: Column, bytes_each: int = 4, growth: Column | None = None, per_second: float = RECORDS_PER_SECOND, energy: float = WATT_HOURS_PER_RECORD) -> dict[str, Column]:
    """disk_bytes, seconds and watt_hours of rewriting n vectors: shadow, 24 bytes a record, growth, a fifth to spare."""
    disk = F.floor((n * dim * bytes_each + 24 * n + (growth if growth is not None else F.lit(0))) * 1.2)
    return {"disk_bytes": disk, "seconds": F.round(n / per_second, 1), "watt_hours": F.round(n * energy, 6)}


def removable(files: DataFrame, now: Column) -> DataFrame:
    """Files (path, class, modified, length) that are past their retention; of backups all but the newest few."""
    from pyspark.sql import Window as W

    limit = F.coalesce(*[F.when(F.col("class") == k, F.lit(v)) for k, v in RETENTION_DAYS.items()])
    order = W.partitionBy("class").orderBy(F.desc("modified"), "path")
    rows = files.where(~F.col("class").isin(*PROTECTED)).withColumn("_rn", F.row_number().over(order))
    old = F.datediff(now, F.col("modified")) > limit
    return rows.where(F.when(F.col("class") == "backups", F.col("_rn") > KEEP_BACKUPS).otherwise(F.coalesce(old, F.lit(False)))).drop("_rn")


def list_files(spark: SparkSession, root: str, classes: Mapping[str, str]) -> DataFrame:
    """(path, class, modified, length) of files under ``root``; class by sub-folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("modificationTime").alias("modified"), "length")
    base = re.sub(r"^[a-z]+:/*", "/", root).rstrip("/") + "/"
    folder = F.regexp_extract(F.substring_index("path", base, -1), r"^([^/]+)/", 1)
    return rows.withColumn("class", F.coalesce(*[F.when(folder == k, F.lit(v)) for k, v in classes.items()], F.lit("other")))


@contextlib.contextmanager
def single_writer(spark: SparkSession, root: str) -> Iterator[None]:
    """A lock file made with create-if-absent; a second writer is refused."""
    fs, path = filesystem(spark, f"{root.rstrip('/')}/LOCK")
    try:
        fs.create(path, False).close()
    except Exception as error:
        raise RuntimeError(f"{root} is being written by another job") from error
    try:
        yield
    finally:
        fs.delete(path, False)


def lru_hits(log: DataFrame, doc: str, order: str, capacity: int, shards: int = 8) -> DataFrame:
    """(shard, lookups, hits) of a cache of ``capacity`` entries that is split by hash into ``shards``.

    A bounded cache is sequential; as a served cache is sharded by key, so is its
    replay: each shard is a sorted stream of its own.
    """
    share = max(1, capacity // shards)
    rows = log.select(F.pmod(F.xxhash64(doc), F.lit(shards)).cast("int").alias("shard"), F.col(doc).cast("string").alias("doc"), F.col(order).alias("_o"))

    def replay(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: OrderedDict[str, None] = OrderedDict()
        shard, lookups, hits = None, 0, 0
        for part in parts:
            for s, d in zip(part.shard, part.doc, strict=True):
                if s != shard:
                    if shard is not None:
                        yield pd.DataFrame({"shard": [shard], "lookups": [lookups], "hits": [hits]})
                    shard, lookups, hits = s, 0, 0
                    held.clear()
                lookups += 1
                if d in held:
                    hits += 1
                    held.move_to_end(d)
                else:
                    held[d] = None
                    if len(held) > share:
                        held.popitem(last=False)
        if shard is not None:
            yield pd.DataFrame({"shard": [shard], "lookups": [lookups], "hits": [hits]})

    return rows.repartition(shards, "shard").sortWithinPartitions("shard", "_o", "doc").mapInPandas(replay, "shard int, lookups long, hits long")
