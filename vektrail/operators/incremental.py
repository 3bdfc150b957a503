"""Processing only new or changed records, exactly once.

The sequence numbers that were processed are kept as disjoint closed intervals.
A run subtracts them from the ranges that are available, processes what is left
(late numbers below the newest one included), and publishes its output and the
merged intervals with one atomic file creation. A run that dies before that
leaves nothing behind.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vektrail.session import delete_path, filesystem, numbered, publish_once


@dataclass(frozen=True)
class Intervals:
    """Disjoint, sorted, closed integer intervals; adjacent ones are joined."""

    spans: tuple[tuple[int, int], ...] = ()

    @classmethod
    def of(cls, spans: Iterable[tuple[int, int]]) -> Intervals:
        out: list[list[int]] = []
        for lo, hi in sorted((int(a), int(b)) for a, b in spans if a <= b):
            if out and lo <= out[-1][1] + 1:
                out[-1][1] = max(out[-1][1], hi)
            else:
                out.append([lo, hi])
        return cls(tuple((a, b) for a, b in out))

    def union(self, other: Intervals) -> Intervals:
        return Intervals.of([*self.spans, *other.spans])

    def minus(self, other: Intervals) -> Intervals:
        left: list[tuple[int, int]] = []
        for lo, hi in self.spans:
            start = lo
            for a, b in other.spans:
                if b < start or a > hi:
                    continue
                if a > start:
                    left.append((start, a - 1))
                start = b + 1
            if start <= hi:
                left.append((start, hi))
        return Intervals.of(left)

    def upto(self, last: int) -> Intervals:
        return Intervals.of((a, min(b, last)) for a, b in self.spans if a <= last)

    def __bool__(self) -> bool:
        return bool(self.spans)

    def contains(self, col: Column) -> Column:
        """Predicate on a column; comparisons only, so it reaches the scan."""
        hit = F.lit(False)
        for lo, hi in self.spans:
            hit = hit | ((col >= lo) & (col <= hi))
        return hit


def available(feed: DataFrame, seq: str) -> Intervals:
    """Islands of the sequence numbers that occur in ``feed`` (nulls left out).

    Distinct numbers are found with map-side combining; what reaches one task is
    one row per batch, and the driver gets one row per island.
    """
    numbers = feed.where(F.col(seq).isNotNull()).select(F.col(seq).cast("long").alias("s")).distinct()
    islands = (
        numbers.withColumn("g", F.col("s") - F.row_number().over(W.orderBy("s")))
        .groupBy("g")
        .agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    )
    return Intervals.of((r.lo, r.hi) for r in islands.collect())


def instant(col: Column) -> Column:
    """UTC instant of ISO-like text: ``T`` or blank, ``Z``, ``+hh:mm``, ``+hhmm`` or no offset (UTC).

    Null, blank and unreadable text give null.
    """
    text = F.upper(F.trim(col))
    text = F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")
    text = F.when(text.rlike(r"(Z|[+-]\d{2}:\d{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.try_to_timestamp(text)


def completed_runs(runs: DataFrame) -> DataFrame:
    """One row (run_no, upto) for each run that took effect; repeated rows count once."""
    return (
        runs.where((F.lower(F.trim("state")) == "completed") & F.col("upto_batch").isNotNull())
        .groupBy("run_no")
        .agg(F.max("upto_batch").cast("long").alias("upto"))
    )


def plan_runs(have: Intervals, runs: Sequence[tuple[int, int]], done: Intervals = Intervals()) -> list[tuple[int, int, Intervals]]:
    """(position, run, gap) for each run in order of its upper bound.

    The gap of a run is what is available up to its bound and was not processed
    by an earlier one.
    """
    plan = []
    for pos, (run, upto) in enumerate(sorted(runs, key=lambda r: (r[1], r[0]))):
        gap = have.upto(upto).minus(done)
        plan.append((pos, run, gap))
        done = done.union(gap)
    return plan


def images(feed: DataFrame, keys: Sequence[str], seq: str, order: Sequence[Column], values: dict[str, Column]) -> DataFrame:
    """(*keys, seq, image): only what the reader needs, so other columns may have any name.

    Images compare by ``order``, nulls first, then by their values.
    """
    image = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], *[c.alias(n) for n, c in values.items()])
    return feed.select(*keys, F.col(seq), image.alias("image"))


def latest_images(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest image of each key.

    A plain ``max`` of a struct: partial aggregation on the map side, so a hot key
    costs one row per task.
    """
    return rows.groupBy(*keys).agg(F.max("image").alias("image"))


def replay(
    feed: DataFrame,
    runs: DataFrame,
    keys: Sequence[str],
    seq: str,
    order: Sequence[Column],
    values: dict[str, Column],
) -> DataFrame:
    """What each completed run of a log had to process: (run_no, *keys).

    A key is a case at a run if its image differs in ``values`` from the image at
    the completed run before, or if it had none. Rows with a null sequence number
    belong to no run. Empty feeds or logs give no rows.
    """
    spark = feed.sparkSession
    log = [(r.run_no, r.upto) for r in completed_runs(runs).collect()]  # a log of runs, not data
    spans = [(pos, run, lo, hi) for pos, run, gap in plan_runs(available(feed, seq), log) for lo, hi in gap.spans]
    plan = spark.createDataFrame(spans, "_pos int, run_no int, _lo long, _hi long")
    numbers = feed.select(seq).distinct()
    owner = numbers.join(plan, (F.col(seq) >= F.col("_lo")) & (F.col(seq) <= F.col("_hi"))).select(seq, "_pos", "run_no")
    per_run = latest_images(images(feed, keys, seq, order, values).join(owner, seq), ["_pos", "run_no", *keys])
    # at most one row per run is left of a key, whatever its number of images
    w = W.partitionBy(*keys).orderBy("_pos")
    now = F.max("image").over(w.rowsBetween(W.unboundedPreceding, 0))
    before = F.max("image").over(w.rowsBetween(W.unboundedPreceding, -1))
    seen = per_run.withColumn("_now", now).withColumn("_before", before)
    same = F.col("_before").isNotNull()
    for name in values:
        same = same & F.col(f"_now.{name}").eqNullSafe(F.col(f"_before.{name}"))
    return seen.where(~same).select("run_no", *keys)


class IncrementalReader:
    """A durable reader: each ``run`` returns only keys that are new or changed.

    ``root`` holds ``out/`` and ``snap/`` (data of runs) and ``commits/`` (one JSON
    file per run: intervals, and which data belong to it). A commit is one file made
    whole or not at all, so of two runs started from the same state only one succeeds,
    and data without a commit are never read. A run reads the images of its own keys
    only and appends those that became newer; after ``COMPACT`` runs the images are
    written anew. ``vacuum`` removes what the newest commit does not need.
    """

    COMPACT = 16

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], seq: str, order: Sequence[Column], values: dict[str, Column]):
        self.spark, self.root, self.keys, self.seq, self.order, self.values = spark, root.rstrip("/"), list(keys), seq, list(order), values

    def state(self) -> dict:
        done = numbered(self.spark, f"{self.root}/commits")
        if not done:
            return {"n": 0, "intervals": [], "snaps": [], "out": None}
        text = self.spark.read.text(f"{self.root}/commits/{done[-1]:08d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def run(self, feed: DataFrame, upto: int, fail_before_commit: bool = False) -> DataFrame:
        """Process all available numbers up to ``upto``; returns the new or changed keys with their values."""
        state = self.state()
        done = Intervals.of(map(tuple, state["intervals"]))
        gap = available(feed.where(F.col(self.seq) <= upto), self.seq).minus(done)
        fresh = latest_images(images(feed.where(gap.contains(F.col(self.seq))), self.keys, self.seq, self.order, self.values), self.keys)
        if state["snaps"]:
            old = latest_images(self.spark.read.parquet(*state["snaps"]), self.keys).withColumnRenamed("image", "_old")
        else:
            old = self.spark.createDataFrame([], T.StructType([*(f for f in fresh.schema if f.name != "image"), T.StructField("_old", fresh.schema["image"].dataType)]))
        on = [fresh[k].eqNullSafe(old[k]) for k in self.keys]
        both = fresh.join(old, on, "left").select(*[fresh[k] for k in self.keys], F.greatest("image", "_old").alias("image"), "_old")
        token = uuid.uuid4().hex
        step = f"{self.root}/step/{token}"
        both.where(~F.col("image").eqNullSafe(F.col("_old"))).write.parquet(step)  # the join runs once
        newer = self.spark.read.parquet(step)
        same = F.col("_old").isNotNull()
        for name in self.values:
            same = same & F.col(f"image.{name}").eqNullSafe(F.col(f"_old.{name}"))
        snap, out = f"{self.root}/snap/{token}", f"{self.root}/out/{token}"
        rows = newer.select(*self.keys, "image")
        whole = len(state["snaps"]) >= self.COMPACT
        if whole:
            rows = latest_images(self.spark.read.parquet(*state["snaps"]).unionByName(rows), self.keys)
        rows.write.parquet(snap)
        newer.where(~same).select(*self.keys, *[F.col(f"image.{n}").alias(n) for n in self.values]).write.parquet(out)
        delete_path(self.spark, step)
        if fail_before_commit:
            raise RuntimeError("stopped before the commit")
        commit = {"n": state["n"] + 1, "intervals": [list(s) for s in done.union(gap).spans], "snaps": [snap] if whole else [*state["snaps"], snap], "out": out}
        if not publish_once(self.spark, f"{self.root}/commits/{commit['n']:08d}.json", json.dumps(commit).encode()):
            raise RuntimeError(f"run {commit['n']} was committed by another reader")
        return self.spark.read.parquet(out)

    def vacuum(self) -> int:
        """Remove images that the newest commit does not name, left by failed runs or compaction; not while another run is at work."""
        keep = {s.rsplit("/", 1)[1] for s in self.state()["snaps"]}
        fs, path = filesystem(self.spark, f"{self.root}/snap")
        gone = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName() not in keep] if fs.exists(path) else []
        for p in gone:
            fs.delete(p, True)
        return len(gone)
