"""Mixing sources to target weights.

Method: Sainte-Laguë apportionment. The mix is a number of blocks of equal size in
tokens. Blocks go one by one to the source with the highest quotient
weight / (2 * blocks so far + 1), up to what the source can give with its repeats; a
source whose quota is cut off by that falls short. The quota of a source is
apportioned to shards in the same way, and each shard selects its blocks in a seeded
order.

The documents of a source lie in a seeded order, and blocks are cut at equal numbers
of running tokens; a document belongs to the block in which its middle token lies, so
a block misses its size by less than a document.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vektrail.llm.encode import token_counts
from vektrail.session import staged, table

BLOCKS = 2_048  # of the whole mix; bounds what the driver plans
SHARDS = 8
LANES = 256  # of a source, over which its documents are spread while tokens are summed up
SEED = 20_260


def sainte_lague(weights: Sequence[float], seats: int, caps: Sequence[int]) -> list[int]:
    """Seats of each party, by highest quotients; a party at its cap is passed over.

    Equal quotients go to the earlier party. Seats nobody can take stay free.
    """
    got = [0] * len(weights)
    heap = [(-w, i) for i, w in enumerate(weights) if w > 0 and caps[i] > 0]
    heapq.heapify(heap)
    for _ in range(seats):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * got[i] + 1), i))
    return got


@dataclass(frozen=True)
class Share:
    """The plan of one source, as far as the driver holds it."""

    source: str
    key: str
    weight: float
    max_repeats: int
    tokens: int  # the source's own
    wanted: float
    blocks: int  # the source is cut into so many, each of ``size`` tokens but for the last
    quota: int
    limit: int  # whole blocks the source can give with its repeats
    size: int  # tokens of a block

    @property
    def short(self) -> bool:
        """The apportionment stopped at what the source can give, and its share in tokens is more than that."""
        return self.quota >= self.limit and self.tokens * self.max_repeats < self.wanted * (1 - 1e-12)


def sized(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, key, tokens) of the documents whose source, trimmed and in lower case, is wanted."""
    wanted = targets.where(F.col("source").isNotNull()).select(F.lower(F.trim("source")).alias("key")).distinct()
    docs = docs.select("doc_id", F.lower(F.trim("source")).alias("key"), "text").join(wanted, "key", "left_semi")
    return token_counts(docs, ["doc_id", "key"], "text")


def plan(sizes: DataFrame, targets: DataFrame, blocks: int = BLOCKS) -> list[Share]:
    """Apportion the mix. One row per source reaches the driver.

    Targets with a null source, weight or repeats are left out; a repeated source
    counts once. A source without documents has 0 tokens and falls short.
    """
    own = {r.key: r.tokens for r in sizes.groupBy("key").agg(F.sum("tokens").alias("tokens")).collect()}
    wanted: dict[str, tuple] = {}
    for r in targets.select("source", "weight", "max_repeats").distinct().orderBy("source", "weight", "max_repeats").collect():
        if None not in (r.source, r.weight, r.max_repeats):
            wanted.setdefault(r.source.strip().lower(), (r.source, float(r.weight), int(r.max_repeats)))
    total = sum(own.get(k) or 0 for k in wanted)
    size = max(1, total // blocks)
    pieces = {k: -(-(own.get(k) or 0) // size) for k in wanted}
    keys = sorted(wanted)
    limits = [(own.get(k) or 0) * wanted[k][2] // size for k in keys]
    quotas = sainte_lague([wanted[k][1] for k in keys], total // size if total else 0, limits)
    return [Share(wanted[k][0], k, wanted[k][1], wanted[k][2], own.get(k) or 0, wanted[k][1] * total, pieces[k], q, m, size) for k, q, m in zip(keys, quotas, limits, strict=True)]


def block_copies(shares: Sequence[Share], shards: int = SHARDS, seed: int = SEED) -> list[tuple[str, int, int, int]]:
    """(key, block, shard, copies) of every block that is used; at most about ``BLOCKS`` plus one per source."""
    out = []
    for s in shares:
        of = [[b for b in range(s.blocks) if b % shards == k] for k in range(shards)]
        quotas = sainte_lague([len(x) for x in of], s.quota, [len(x) * s.max_repeats for x in of])
        for shard, (mine, quota) in enumerate(zip(of, quotas, strict=True)):
            if not mine:
                continue
            every, extra = divmod(quota, len(mine))
            order = sorted(mine, key=lambda b: hashlib.md5(f"{seed}|{s.key}|{b}".encode()).digest())
            out += [(s.key, b, shard, every + (i < extra)) for i, b in enumerate(order) if every + (i < extra)]
    return out


def in_blocks(sizes: DataFrame, shares: Sequence[Share], seed: int = SEED) -> DataFrame:
    """(doc_id, key, tokens, block): every document in the block of its middle token.

    Documents of a source are dealt by hash to ``LANES`` lanes and ordered by hash within
    them; a lane begins where the one before ends. Sums run within a lane, so no source
    is gathered in one task.
    """
    spark = sizes.sparkSession
    cut = spark.createDataFrame([(s.key, s.size, s.blocks) for s in shares if s.blocks], "key string, size long, blocks int")
    code = F.xxhash64("doc_id", F.lit(seed))
    rows = sizes.join(F.broadcast(cut), "key").withColumn("lane", F.pmod(code, F.lit(LANES)).cast("int"))  # one row per source
    ends = rows.groupBy("key", "lane").agg(F.sum("tokens").alias("all"))
    before = F.sum("all").over(W.partitionBy("key").orderBy("lane").rowsBetween(W.unboundedPreceding, -1))
    ends = ends.select("key", "lane", F.coalesce(before, F.lit(0)).alias("before"))
    so_far = F.sum("tokens").over(W.partitionBy("key", "lane").orderBy(code, "doc_id").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("end", so_far).join(ends, ["key", "lane"])
    middle = F.col("before") + F.col("end") - F.col("tokens") / 2
    return rows.select("doc_id", "key", "tokens", F.least(F.floor(middle / F.col("size")), F.col("blocks") - 1).cast("int").alias("block"))


def mixed(sizes: DataFrame, shares: Sequence[Share], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, shard, copies, tokens): the mix, one row per document that is used."""
    spark = sizes.sparkSession
    names = spark.createDataFrame([(s.key, s.source) for s in shares], "key string, source string")
    chosen = spark.createDataFrame(block_copies(shares, shards, seed), "key string, block int, shard int, copies int")
    placed = in_blocks(sizes, shares, seed).join(F.broadcast(names), "key")  # one row per source
    return placed.join(F.broadcast(chosen), ["key", "block"]).select("doc_id", "source", "shard", "copies", "tokens")  # bounded by BLOCKS


def _start(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, sf_dir, "mix_targets")
    return staged(sized(table(spark, sf_dir, "documents"), targets), "sizes"), targets


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source): the sources that cannot reach their share."""
    sizes, targets = _start(spark, sf_dir)
    return spark.createDataFrame([(s.source,) for s in plan(sizes, targets) if s.short], "source string")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, shard, copies, tokens) of the mix."""
    sizes, targets = _start(spark, sf_dir)
    return mixed(sizes, plan(sizes, targets))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, weight, share, tokens, own_tokens, short): what each source was to give and gave."""
    sizes, targets = _start(spark, sf_dir)
    shares = plan(sizes, targets)
    used = mixed(sizes, shares).groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    wanted = spark.createDataFrame([(s.source, s.weight, s.tokens, s.short) for s in shares], "source string, weight double, own_tokens long, short boolean")
    total = used.agg(F.sum("tokens").alias("total"))
    full = wanted.join(used, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0))).crossJoin(total)  # one row
    return full.select("source", "weight", F.round(F.col("tokens") / F.col("total"), 6).alias("share"), "tokens", "own_tokens", "short")
