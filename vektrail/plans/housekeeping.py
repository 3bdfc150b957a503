"""Queries of approximate search, encoders, budgets and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from vektrail.operators import ann, housekeeping
from vektrail.plans.fixtures import IS_QUERY, old
from vektrail.session import table
from vektrail.sources import encoders


def ann_cells(s, d):
    """Search with all cells probed: equal to the exact search."""
    index = ann.CellIndex(old(s, d), 8)
    return index.search(old(s, d).where(IS_QUERY), 5, 8, self_mask=True).withColumn("score", F.round("score", 6))


def ann_health(s, d):
    """The fewest probed cells of 16 that find nine tenths of the exact neighbours, and what they find."""
    index = ann.CellIndex(old(s, d), 16)
    probes, _ = ann.probes_for(index, old(s, d))
    return ann.health(index, old(s, d), probes=probes).withColumn("probes", F.lit(probes))


def enc_hashing(s, d):
    rows = table(s, d, "documents").select(F.col("doc_id").alias("key"), "text")
    got = encoders.open_encoder("hashing", dim=16)(rows)
    return got.where(F.col("v").isNotNull()).select("key", F.posexplode("v").alias("i", "x")).where("x > 0").select("key", "i", F.round("x", 6).alias("x"))


def enc_precomputed(s, d):
    known = table(s, d, "documents").where("text IS NOT NULL").groupBy("text").agg(F.min("doc_id").cast("double").alias("m")).select("text", F.array("m").alias("v"))
    texts = table(s, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("key"), "text")
    return encoders.precomputed(texts, known).select("key", F.get("v", F.lit(0)).alias("first"))


def enc_profiles(s, d):
    plain, long = encoders.Profile("model-a", 64), encoders.Profile("model-b", 128, "query: ", "passage: ")
    prof = encoders.profile_table(s, [plain, long])
    return prof.select("model_id", "dim", encoders.prefixed(F.lit("text"), F.lit("query"), long).alias("sample"))


def ops_budget(s, d):
    jobs = table(s, d, "jobs").select("job_id", F.col("total_records").cast("double").alias("n"))
    return jobs.select("job_id", *[v.alias(k) for k, v in housekeeping.rewrite_budget(F.col("n"), F.lit(384)).items()])


def ops_retention(s, d):
    kinds = F.array(*[F.lit(x) for x in ("reports", "cache", "tmp", "backups", "shadow")])
    files = table(s, d, "documents").where("ingested_utc IS NOT NULL").select(F.col("doc_id").cast("string").alias("path"), F.get(kinds, (F.col("doc_id") % 5).cast("int")).alias("class"), F.col("ingested_utc").alias("modified"), F.col("n_chars").alias("length"))
    return housekeeping.removable(files, F.lit("2026-03-05").cast("date")).select("path", "class")


def cache_lru(s, d):
    log = table(s, d, "hits").select("id", F.struct("query_id", "side", "rank").alias("at"))
    return housekeeping.lru_hits(log, "id", "at", 400).agg(F.sum("lookups").alias("lookups"), F.sum("hits").alias("hits"))


QUERIES = {f.__name__: f for f in (ann_cells, ann_health, enc_hashing, enc_precomputed, enc_profiles, ops_budget, ops_retention, cache_lru)}

ORACLES = {
    "ann_cells": """WITH o AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
u AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM o),
r AS (SELECT q.id AS query_id, d.id AS doc_id, round(list_dot_product(q.v, d.v), 9) AS score, row_number() OVER (PARTITION BY q.id ORDER BY round(list_dot_product(q.v, d.v), 9) DESC, d.id) - 1 AS rank FROM u q JOIN u d ON q.id <> d.id WHERE q.id % 5 = 0)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank < 5""",
    "enc_hashing": """WITH w AS (SELECT doc_id AS key, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents WHERE text IS NOT NULL),
c AS (SELECT key, ('0x' || substr(md5(word), 1, 8))::BIGINT % 16 AS i, count(*) AS n FROM w GROUP BY 1, 2)
SELECT key, i, round(n / sqrt(sum(n * n) OVER (PARTITION BY key)), 6) AS x FROM c""",
    "enc_precomputed": "SELECT doc_id AS key, (min(doc_id) OVER (PARTITION BY text))::DOUBLE AS first FROM documents WHERE text IS NOT NULL",
    "enc_profiles": "SELECT * FROM (VALUES ('model-a', 64, 'query: text'), ('model-b', 128, 'query: text')) t(model_id, dim, sample)",
    "ops_budget": "SELECT job_id, floor((total_records * 384 * 4 + 24 * total_records) * 1.2::DOUBLE)::BIGINT AS disk_bytes, round(total_records / 40.0::DOUBLE, 1) AS seconds, round(total_records * 0.0001::DOUBLE, 6) AS watt_hours FROM jobs",
    "ops_retention": """WITH f AS (SELECT doc_id::VARCHAR AS path, ['reports', 'cache', 'tmp', 'backups', 'shadow'][doc_id % 5 + 1] AS class, ingested_utc AS modified FROM documents WHERE ingested_utc IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY modified DESC, path) AS rn, date_diff('day', modified::DATE, DATE '2026-03-05') AS age FROM f)
SELECT path, class FROM r WHERE (class = 'backups' AND rn > 3) OR (class = 'reports' AND age > 90) OR (class = 'cache' AND age > 30) OR (class = 'tmp' AND age > 1)""",
}
