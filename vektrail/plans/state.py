"""Queries of the job queue, rewrites, caches and audit chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from vektrail.operators import audit, state
from vektrail.operators.incremental import instant
from vektrail.plans.fixtures import new, old
from vektrail.session import table
from vektrail.sources import uri

KEYS = ["job_id", "record_id"]


def _events(s, d):
    feed = table(s, d, "job_items")
    return feed.select(*KEYS, F.lower(F.trim("state")).alias("state"), "priority", "attempts", F.struct(instant(F.col("updated_utc")).alias("at"), F.col("attempts").alias("n"), F.lower(F.trim("state")).alias("st")).alias("seq"))


def job_latest(s, d):
    return state.latest(_events(s, d), KEYS, "seq").select(*KEYS, "state", "attempts", "priority")


def job_stats(s, d):
    return state.stats(job_latest(s, d), ["job_id"])


def job_next_batch(s, d):
    return state.next_batch(job_latest(s, d).groupBy("record_id").agg(F.max("priority").alias("priority"), F.max_by("state", F.col("job_id")).alias("state")), 100)


def job_mixed_spaces(s, d):
    return state.mixed_spaces(job_latest(s, d), ["job_id"]).select("job_id", "done", "total")


def job_enqueue(s, d):
    have = table(s, d, "job_items").where("batch_no <= 5")
    return state.enqueue(have, table(s, d, "job_items").where("batch_no > 5"), KEYS).groupBy("job_id").agg(F.count("*").alias("added"))


def job_page(s, d):
    return state.page(table(s, d, "job_items").select("record_id").distinct(), "doc-3", 50)


def job_retry(s, d):
    return table(s, d, "job_items").groupBy(*KEYS).agg(F.max("attempts").alias("attempts")).groupBy("attempts").agg(F.count("*").alias("items"))


def job_declared(s, d):
    """Declared against seen items of each job."""
    seen = table(s, d, "job_items").select(*KEYS).distinct().groupBy("job_id").agg(F.count("*").alias("seen"))
    return table(s, d, "jobs").select("job_id", "total_records").join(seen, "job_id", "left").select("job_id", F.coalesce("seen", F.lit(0)).alias("seen"), "total_records")


def job_upsert(s, d):
    """A half-done rewrite: migrated rows hold new vectors."""
    got = state.upsert(old(s, d), new(s, d).where("id % 10 < 4").select("id", "v"))
    return got.select("id", F.round(F.get("v", F.lit(0)), 6).alias("first"), "label")


def job_rollback(s, d):
    shadow = old(s, d).where("id % 10 < 4").select("id", "v")
    return state.upsert(state.upsert(old(s, d), new(s, d).where("id % 10 < 4").select("id", "v")), shadow).select("id", F.round(F.get("v", F.lit(0)), 6).alias("first"))


def job_verify(s, d):
    return state.verify_sample(state.upsert(old(s, d), new(s, d).select("id", "v")), new(s, d), share=1.0).select("checked", "ok")


def cache_hit_miss(s, d):
    keys = table(s, d, "hits").select(F.substring_index("id", "-", -1).cast("long").alias("key"))
    return state.cache_stats(keys, table(s, d, "vec_documents").select(F.col("doc_id").alias("key")))


def cache_missing(s, d):
    keys = table(s, d, "hits").select(F.substring_index("id", "-", -1).cast("long").alias("key"))
    return state.missing_in_cache(keys, table(s, d, "vec_documents").select(F.col("doc_id").alias("key")))


def cache_replay(s, d):
    log = table(s, d, "hits").select("query_id", "side", "id", F.col("rank").alias("r"))
    return state.replay_hits(log, "id", ["query_id", "side", "r"])


def _chain(s):
    return audit.seal(s, [{"ts_utc": f"2026-02-{i + 1:02d}T00:00:00Z", "run_id": f"run-{i % 3}", "action": ("probe", "fit", "migrate")[i % 3], "inputs": {"n": i, "b": True}, "outputs": {"score": i / 10}} for i in range(20)])


def aud_verify(s, d):
    return audit.verify(_chain(s))


def aud_tamper(s, d):
    bad = _chain(s).withColumn("outputs", F.when(F.col("seq") == 7, F.lit("{}")).otherwise(F.col("outputs")))
    return audit.verify(bad)


def aud_prune(s, d):
    kept, last = audit.pruned(_chain(s), "2026-02-06T00:00:00Z")
    head = kept.orderBy(F.desc("seq")).first()
    mark = audit.seal(s, [{"ts_utc": "2026-03-01T00:00:00Z", "run_id": "run-9", "action": "prune", "inputs": {"gap_after_seq": last}}], head.seq, head.hash)
    return audit.verify(kept.unionByName(mark))


def aud_listed(s, d):
    return audit.listed(_chain(s), action="fit", since="2026-02-05T00:00:00Z", limit=4).select("seq", "ts_utc", "run_id")


def aud_actions(s, d):
    return audit.actions(_chain(s))


def ops_uri(s, d):
    return uri.parsed(table(s, d, "jobs"), "store_uri").select("job_id", "scheme", "location", "collection")


def ops_fingerprint(s, d):
    """Cache keys of texts under an encoding profile: SHA-256 of profile and text."""
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(F.concat_ws("\x1f", F.lit("model-a"), F.lit("64"), "text"), 256).alias("key"))


QUERIES = {f.__name__: f for f in (job_latest, job_stats, job_next_batch, job_mixed_spaces, job_enqueue, job_page, job_retry, job_declared, job_upsert, job_rollback, job_verify, cache_hit_miss, cache_missing, cache_replay, aud_verify, aud_tamper, aud_prune, aud_listed, aud_actions, ops_uri, ops_fingerprint)}

_FEED = """feed AS (SELECT job_id, record_id, lower(trim(state)) AS state, attempts, priority,
  coalesce(CAST(CASE WHEN updated_utc IS NULL THEN NULL WHEN regexp_matches(updated_utc, '(Z|[+-][0-9]{2}:?[0-9]{2})$')
    THEN regexp_replace(updated_utc, '([+-][0-9]{2})([0-9]{2})$', '\\1:\\2') ELSE updated_utc || 'Z' END AS TIMESTAMPTZ), TIMESTAMPTZ '0001-01-01 00:00:00+00') AS moment FROM job_items),
cur AS (SELECT job_id, record_id, state, attempts, priority FROM (SELECT *, row_number() OVER (PARTITION BY job_id, record_id ORDER BY moment DESC, attempts DESC, state DESC) AS rn FROM feed) WHERE rn = 1)"""
_STATS = "SELECT job_id, count(*) AS total, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state IN ('pending', 'shadowed')) AS remaining, round(count(*) FILTER (state = 'done') / count(*), 9) AS fraction FROM cur GROUP BY job_id"
ORACLES = {
    "job_latest": f"WITH {_FEED} SELECT job_id, record_id, state, attempts, priority FROM cur",
    "job_stats": f"WITH {_FEED} {_STATS}",
    "job_next_batch": f"WITH {_FEED}, r AS (SELECT record_id, max(priority) AS priority, arg_max(state, job_id) AS state FROM cur GROUP BY record_id) SELECT record_id, priority, state FROM r WHERE state IN ('pending', 'shadowed') ORDER BY priority DESC, record_id LIMIT 100",
    "job_mixed_spaces": f"WITH {_FEED} SELECT job_id, done, total FROM ({_STATS}) WHERE done > 0 AND done < total",
    "job_enqueue": "WITH have AS (SELECT DISTINCT job_id, record_id FROM job_items WHERE batch_no <= 5), inc AS (SELECT DISTINCT job_id, record_id FROM job_items WHERE batch_no > 5) SELECT job_id, count(*) AS added FROM inc WHERE (job_id, record_id) NOT IN (SELECT (job_id, record_id) FROM have) GROUP BY job_id",
    "job_page": "SELECT DISTINCT record_id FROM job_items WHERE record_id > 'doc-3' ORDER BY record_id LIMIT 50",
    "job_retry": "SELECT attempts, count(*) AS items FROM (SELECT max(attempts) AS attempts FROM job_items GROUP BY job_id, record_id) GROUP BY attempts",
    "job_declared": "SELECT j.job_id AS job_id, count(DISTINCT i.record_id) AS seen, any_value(j.total_records) AS total_records FROM jobs j LEFT JOIN job_items i ON i.job_id = j.job_id GROUP BY j.job_id",
    "job_upsert": "SELECT vec_id AS id, round((CASE WHEN vec_id % 10 < 4 THEN embedding[64] ELSE embedding[1] END)::DOUBLE, 6) AS first, label FROM embeddings",
    "job_rollback": "SELECT vec_id AS id, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings",
    "job_verify": "SELECT count(*) AS checked, TRUE AS ok FROM embeddings",
    "cache_hit_miss": "WITH k AS (SELECT split_part(id, '-', 2)::BIGINT AS key FROM hits), c AS (SELECT DISTINCT doc_id FROM vec_documents) SELECT count(*) AS lookups, count(DISTINCT key) AS distinct_keys, count(c.doc_id) AS hits, count(*) - count(c.doc_id) AS misses, round(count(c.doc_id) / count(*), 9) AS hit_rate FROM k LEFT JOIN c ON c.doc_id = k.key",
    "cache_missing": "SELECT DISTINCT split_part(id, '-', 2)::BIGINT AS key FROM hits WHERE split_part(id, '-', 2)::BIGINT NOT IN (SELECT doc_id FROM vec_documents)",
    "cache_replay": "SELECT count(*) AS lookups, (count(*) - count(DISTINCT id))::BIGINT AS hits FROM hits",
    "aud_verify": "SELECT 20::BIGINT AS records, 0::BIGINT AS broken, NULL::BIGINT AS first_broken",
    "aud_tamper": "SELECT 20::BIGINT AS records, 1::BIGINT AS broken, 7::BIGINT AS first_broken",
    "aud_prune": "SELECT 16::BIGINT AS records, 0::BIGINT AS broken, NULL::BIGINT AS first_broken",
    "aud_listed": "SELECT * FROM (VALUES (20, '2026-02-20T00:00:00Z', 'run-1'), (17, '2026-02-17T00:00:00Z', 'run-1'), (14, '2026-02-14T00:00:00Z', 'run-1'), (11, '2026-02-11T00:00:00Z', 'run-1')) t(seq, ts_utc, run_id)",
    "aud_actions": "SELECT * FROM (VALUES ('probe', 7), ('fit', 7), ('migrate', 6)) t(action, records)",
    "ops_uri": "SELECT job_id, nullif(regexp_extract(store_uri, '^([a-z][a-z0-9+.-]*):', 1), '') AS scheme, nullif(regexp_extract(store_uri, '^[a-z][a-z0-9+.-]*://([^#]*)', 1), '') AS location, nullif(regexp_extract(store_uri, '#(.*)$', 1), '') AS collection FROM jobs",
    "ops_fingerprint": "SELECT doc_id, sha256('model-a' || chr(31) || '64' || chr(31) || text) AS key FROM documents WHERE text IS NOT NULL",
}
