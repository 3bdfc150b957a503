"""Hash-chained audit records: sealing, verification, pruning with a recorded gap, export."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GENESIS = "0" * 64  # fixed value: what the first record links to
SCHEMA = "seq long, ts_utc string, run_id string, action string, subject string, inputs string, outputs string, prev_hash string, hash string"
PAYLOAD = ("action", "inputs", "outputs", "prev_hash", "run_id", "subject", "ts_utc")


def canonical(value: object) -> str:
    """JSON with sorted keys and no blanks."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def payload() -> Column:
    """What is hashed: the fields but seq and hash, joined by the unit separator; null is empty."""
    return F.concat_ws("\x1f", *[F.coalesce(F.col(c), F.lit("")) for c in PAYLOAD])


def seal(spark: SparkSession, records: Iterable[dict], last_seq: int = 0, last_hash: str = GENESIS) -> DataFrame:
    """Append records to a chain. Sealing is sequential, so it runs on the driver, over the few records of one run."""
    rows = []
    for r in records:
        last_seq += 1
        row = {"ts_utc": r["ts_utc"], "run_id": r["run_id"], "action": r["action"], "subject": r.get("subject"), "inputs": canonical(r.get("inputs", {})), "outputs": canonical(r.get("outputs", {})), "prev_hash": last_hash}
        last_hash = hashlib.sha256("\x1f".join(row[c] or "" for c in PAYLOAD).encode()).hexdigest()
        rows.append((last_seq, row["ts_utc"], row["run_id"], row["action"], row["subject"], row["inputs"], row["outputs"], row["prev_hash"], last_hash))
    return spark.createDataFrame(rows, SCHEMA)


def checked(chain: DataFrame) -> DataFrame:
    """Each record with content_ok and link_ok.

    A record after a recorded gap (action ``prune``, inputs ``gap_after_seq``) may link
    to a record that is gone.
    """
    before = F.lag("hash").over(W.orderBy("seq"))  # one row per audit record
    gaps = chain.where("action = 'prune'").select((F.get_json_object("inputs", "$.gap_after_seq").cast("long") + 1).alias("seq")).distinct().withColumn("gap", F.lit(True))
    rows = chain.withColumn("_before", before).join(gaps, "seq", "left")
    link = F.col("prev_hash") == F.coalesce("_before", F.lit(GENESIS))
    return rows.withColumn("content_ok", F.sha2(payload(), 256) == F.col("hash")).withColumn("link_ok", link | F.coalesce("gap", F.lit(False))).drop("_before", "gap")


def verify(chain: DataFrame) -> DataFrame:
    """(records, broken, first_broken): an empty chain is intact."""
    bad = ~(F.col("content_ok") & F.col("link_ok"))
    return checked(chain).agg(F.count("*").alias("records"), F.sum(bad.cast("long")).alias("broken"), F.min(F.when(bad, F.col("seq"))).alias("first_broken")).fillna(0, ["broken"])


def listed(chain: DataFrame, action: str | None = None, since: str | None = None, run_id: str | None = None, limit: int = 50) -> DataFrame:
    """The newest records that match all given filters."""
    for col, op, value in (("action", "=", action), ("ts_utc", ">=", since), ("run_id", "=", run_id)):
        if value is not None:
            chain = chain.where((F.col(col) == value) if op == "=" else (F.col(col) >= value))
    return chain.orderBy(F.desc("seq")).limit(limit)


def actions(chain: DataFrame) -> DataFrame:
    return chain.groupBy("action").agg(F.count("*").alias("records"))


def pruned(chain: DataFrame, before: str) -> tuple[DataFrame, int]:
    """Records from ``before`` on, and the last sequence number that was cut off (0 if none)."""
    last = chain.where(F.col("ts_utc") < before).agg(F.max("seq")).first()[0] or 0
    return chain.where(F.col("seq") > last), last


def export(chain: DataFrame) -> DataFrame:
    """(value): one JSON line per record, in order of seq."""
    return chain.orderBy("seq").select(F.to_json(F.struct(*sorted(chain.columns))).alias("value"))


def replay_compare(recorded: DataFrame, again: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(name, old, new, same): recorded numbers against those of a second run; a missing one is not the same."""
    both = recorded.select("name", F.col("value").alias("old")).join(again.select("name", F.col("value").alias("new")), "name", "full_outer")
    return both.withColumn("same", F.coalesce(F.abs(F.col("old") - F.col("new")) <= tolerance, F.lit(False)))
