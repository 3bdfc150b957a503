"""Rewriting an index into another space as a resumable stream.

The work list is written once as numbered Parquet files in priority order. A stream
reads a few files per micro-batch until none is left; its checkpoint is the resume
point. Each batch is shadowed first, then mapped and written, then read back, and
only then marked done. Output is keyed by the batch number, so a batch that is
repeated after a failure replaces its own files. A batch whose write is refused is
halved, and only the rows of the parts that stay refused are marked failed.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vektrail.operators import state
from vektrail.operators.adapters import FITS, Adapter, Moments, held_out_gain
from vektrail.session import delete_path, filesystem


@dataclass(frozen=True)
class Outcome:
    """What is left of a job after a run."""

    done: int
    failed: int
    pending: int
    finished: bool


def retried(action: Callable[[], None], attempts: int = 3, first_wait: float = 0.5, longest: float = 8.0) -> None:
    """Run ``action`` again after a fault of the store, with growing pauses."""
    for n in range(attempts):
        try:
            return action()
        except (OSError, PySparkException):
            if n == attempts - 1:
                raise
            time.sleep(min(longest, first_wait * 2**n))


def bisected(rows: DataFrame, write: Callable[[DataFrame], None], key: str = "id", depth: int = 4) -> Iterator[tuple[DataFrame, bool]]:
    """Write a batch; one that is rejected is halved by hash, at most ``depth`` times. Yields (rows, written)."""
    try:
        write(rows)
        yield rows, True
    except Exception:
        if depth <= 0 or rows.limit(2).count() < 2:
            yield rows, False
            return
        half = F.pmod(F.xxhash64(F.col(key), F.lit(depth)), F.lit(2))
        for side in (0, 1):
            yield from bisected(rows.where(half == side), write, key, depth - 1)


def refitted(pairs: DataFrame, current: Adapter, kind: str = "linear", least: int = 1_000, margin: float = 0.01) -> Adapter:
    """A map fitted on four fifths of new pairs (id, src, dst), if it beats the current one on the last fifth by ``margin``.

    Fewer than ``least`` pairs keep the current map.
    """
    if pairs.limit(least).count() < least:
        return current
    held = F.pmod(F.xxhash64("id"), F.lit(5)) == 0
    candidate = FITS[kind](Moments.of(pairs.where(~held)))
    gain = held_out_gain(pairs.where(held), current, candidate).first()
    return candidate if gain.new - gain.now >= margin else current


class Rewrite:
    """One job. ``root`` holds work/, shadow/, out/, events/, checkpoint/ and a PAUSE file while paused."""

    def __init__(self, spark: SparkSession, root: str, adapter: Adapter, index: DataFrame, refit: Callable[[Adapter, DataFrame], Adapter] | None = None, refit_every: int = 50_000):
        """``refit`` gets the map and the ids not rewritten yet, every ``refit_every`` rows, and returns the map to go on with."""
        self.spark, self.root, self.adapter, self.index = spark, root.rstrip("/"), adapter, index
        self.refit, self.refit_every, self.since = refit, refit_every, 0

    def _exists(self, name: str) -> bool:
        fs, path = filesystem(self.spark, f"{self.root}/{name}")
        return fs.exists(path)

    def prepare(self, priorities: DataFrame | None = None, batch_size: int = 1_000) -> int:
        """Write the work list; does nothing if it exists. Returns the number of batches.

        Rows are numbered by a global sort over (priority, id), whose ranges are the
        batches: no window over the whole table.
        """
        if not self._exists("work"):
            ids = self.index.select("id")
            rows = ids.withColumn("priority", F.lit(0.0)) if priorities is None else ids.join(priorities, "id", "left").fillna(0.0, ["priority"])
            count = max(1, math.ceil(self.index.count() / batch_size))
            rows.repartitionByRange(count, F.desc("priority"), "id").sortWithinPartitions(F.desc("priority"), "id").write.parquet(f"{self.root}/work")
        return self.spark.read.parquet(f"{self.root}/work").select(F.input_file_name().alias("f")).distinct().count()

    def pause(self) -> None:
        fs, path = filesystem(self.spark, f"{self.root}/PAUSE")
        fs.create(path, True).close()

    def resume(self) -> None:
        fs, path = filesystem(self.spark, f"{self.root}/PAUSE")
        fs.delete(path, False)

    def _store(self, rows: DataFrame, path: str) -> None:
        rows.write.mode("overwrite").parquet(path)

    def _written(self, mapped: DataFrame, number: int) -> tuple[list[tuple[str, DataFrame]], list[DataFrame]]:
        """Write a batch, whole if possible, else in parts: (path, rows) of what was written, and the rows refused.

        The whole batch is tried again after a fault, its parts are not.
        """
        whole = f"{self.root}/out/batch={number}"
        fs, pattern = filesystem(self.spark, f"{whole}_*")
        for path in [whole, *[f.getPath().toString() for f in fs.globStatus(pattern) or []]]:  # of an earlier attempt
            delete_path(self.spark, path)
        tried: list[str] = []

        def write(rows: DataFrame) -> None:
            tried.append(f"{whole}_{len(tried)}" if tried else whole)
            try:
                if len(tried) > 1:
                    self._store(rows, tried[-1])
                else:
                    retried(lambda: self._store(rows, whole))
            except Exception:
                delete_path(self.spark, tried[-1])
                raise

        paths, refused = [], []
        for rows, written in bisected(mapped, write):
            if written:
                paths.append((tried[-1], rows))
            else:
                refused.append(rows)
        return paths, refused

    def _batch(self, work: DataFrame, number: int) -> None:
        rows = work.join(self.index.select("id", "v"), "id").select("id", "v")
        usable = rows.where(F.col("v").isNotNull() & (F.size("v") > 0))
        usable.write.mode("overwrite").parquet(f"{self.root}/shadow/batch={number}")
        mapped = self.spark.read.parquet(f"{self.root}/shadow/batch={number}").withColumn("v", self.adapter.udf(normalize=True)(F.col("v")))
        paths, refused = self._written(mapped, number)
        good = True
        if paths:
            expected = reduce(DataFrame.unionByName, [part for _, part in paths])
            good = state.verify_sample(self.spark.read.parquet(*[path for path, _ in paths]), expected).first().ok
        bad = reduce(DataFrame.unionByName, [part.select("id") for part in refused], mapped.select("id").limit(0)).distinct()
        marks = work.select("id").join(usable.select("id", F.lit(True).alias("_u")), "id", "left").join(bad.withColumn("_r", F.lit(True)), "id", "left")
        # rows without a vector stay pending, unless the whole batch has none
        none = usable.isEmpty()
        status = F.when(F.col("_r"), F.lit("failed")).when(F.col("_u"), F.lit("done" if good else "failed")).otherwise(F.lit("skipped" if none else "pending"))
        marks.select("id", status.alias("state"), F.lit(number).cast("long").alias("seq")).write.mode("overwrite").parquet(f"{self.root}/events/batch={number}")

    def run(self, files_per_batch: int = 1, most_batches: int | None = None) -> Outcome:
        """Process what is left, or stop at a pause or after ``most_batches``; call again to go on."""
        schema = self.spark.read.parquet(f"{self.root}/work").schema
        source = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{self.root}/work")
        seen = {"n": 0}

        class Stopped(Exception):
            pass

        def step(rows: DataFrame, number: int) -> None:
            if self._exists("PAUSE") or (most_batches is not None and seen["n"] >= most_batches):
                raise Stopped("stopped between two batches")
            self._batch(rows, number)
            seen["n"] += 1
            self.since += rows.count() if self.refit else 0
            if self.refit and self.since >= self.refit_every:
                self.since = 0
                self.adapter = self.refit(self.adapter, self.items().where("state = 'pending'").select("id"))

        query = source.writeStream.foreachBatch(step).option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except PySparkException as error:
            if "stopped between two batches" not in str(error):
                raise
        return self.outcome()

    def items(self) -> DataFrame:
        """(id, state): the newest state of each row of the index."""
        ids = self.index.select("id")
        if not self._exists("events"):
            return ids.withColumn("state", F.lit("pending"))
        marks = state.latest(self.spark.read.parquet(f"{self.root}/events").select("id", "state", "seq"), ["id"], "seq")
        return ids.join(marks.select("id", "state"), "id", "left").withColumn("state", F.coalesce("state", F.lit("pending")))

    def outcome(self) -> Outcome:
        got = {r.state: r["count"] for r in self.items().groupBy("state").count().collect()}
        pending = got.get("pending", 0)
        return Outcome(got.get("done", 0), got.get("failed", 0), pending, pending == 0)

    def current(self) -> DataFrame:
        """The index as it stands: rewritten rows from out/, the others as they were."""
        if not self._exists("out"):
            return self.index
        done = self.items().where("state = 'done'").select("id")
        if done.isEmpty():  # out/ may be without files
            return self.index
        out = self.spark.read.parquet(f"{self.root}/out").select("id", "v").join(done, "id", "left_semi")
        return state.upsert(self.index.withColumn("v", F.col("v").cast("array<double>")), out)

    def rolled_back(self) -> DataFrame:
        """The index with every shadowed vector put back."""
        shadow = self.spark.read.parquet(f"{self.root}/shadow").select("id", F.col("v").cast("array<double>").alias("v"))
        return state.upsert(self.current(), shadow)
