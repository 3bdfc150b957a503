"""Queries of sampling, splitting, query synthesis and text sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from vektrail.operators import sampling, synthesis
from vektrail.plans.fixtures import old
from vektrail.session import table
from vektrail.sources import logs


def _docs(s, d):
    return table(s, d, "documents").select(F.col("doc_id").alias("id"), "text", "source", "lang", "n_chars", "ingested_utc")


def _counts(s, d):
    return table(s, d, "events").select(F.get_json_object("props", "$.k").cast("long").alias("id")).groupBy("id").agg(F.count("*").alias("count"))


def smp_uniform(s, d):
    return sampling.uniform(old(s, d), 250, seed=11).select("id")


def smp_reservoir(s, d):
    return sampling.reservoir(_docs(s, d), 300, seed=12).select("id")


def smp_split(s, d):
    return sampling.split(old(s, d), 120, seed=13).select("id", "role")


def smp_split_weighted(s, d):
    weighted = sampling.access_weights(old(s, d), _counts(s, d))
    return sampling.split(weighted, 120, seed=14, weight="weight").select("id", "role")


def smp_access_weights(s, d):
    return sampling.access_weights(old(s, d), _counts(s, d)).select("id", "weight")


def smp_stratified(s, d):
    return sampling.stratified(old(s, d), 200, "label", seed=15).groupBy("label").agg(F.count("*").alias("drawn"), F.min("id").alias("first"))


def smp_cluster_sizes(s, d):
    return old(s, d).groupBy("label").agg(F.count("*").alias("rows"))


def src_blank_text(s, d):
    return _docs(s, d).where(~synthesis.blank(F.col("text"))).groupBy("source").agg(F.count("*").alias("docs"))


def src_query_log(s, d):
    """A query log is made of the events and read back through the log parser."""
    lines = table(s, d, "events").select(F.concat(F.lit('{"text": "'), "event_type", F.lit('", "doc_ids": ["'), F.get_json_object("props", "$.k"), F.lit('"]}')).alias("value"), F.col("event_id").alias("line"))
    queries, qrels = logs.parse_query_log(lines)
    return queries.join(qrels, "line").groupBy("query", "doc_id").agg(F.count("*").alias("uses"))


def src_access_log(s, d):
    lines = table(s, d, "events").select(F.concat(F.lit('{"record_id": "'), "user_id", F.lit('", "count": '), "event_id", F.lit("}")).alias("value"), F.col("event_id").alias("line"))
    return logs.parse_access_log(lines)


def syn_title(s, d):
    return _docs(s, d).select("id", synthesis.title(F.col("text")).alias("title"))


def syn_lead(s, d):
    return _docs(s, d).select("id", synthesis.lead(F.col("text")).alias("lead"))


def syn_keywords(s, d):
    return synthesis.keywords(_docs(s, d), "id", "text")


def syn_queries(s, d):
    return synthesis.queries(_docs(s, d), "id", "text")


QUERIES = {f.__name__: f for f in (smp_uniform, smp_reservoir, smp_split, smp_split_weighted, smp_access_weights, smp_stratified, smp_cluster_sizes, src_blank_text, src_query_log, src_access_log, syn_title, syn_lead, syn_keywords, syn_queries)}


def _draw(seed: int, key: str = "id") -> str:
    return f"('0x' || substr(md5('{seed}|' || {key}), 1, 8))::BIGINT"


_E = "e AS (SELECT vec_id AS id, label FROM embeddings)"
_C = "c AS (SELECT (props->>'$.k')::BIGINT AS id, count(*)::DOUBLE AS n FROM events GROUP BY 1), w AS (SELECT e.id AS id, coalesce(c.n, 1.0) AS weight FROM e LEFT JOIN c ON c.id = e.id)"
_FLAT = "trim(regexp_replace({0}, '[ \\t\\n\\r\\f]+', ' ', 'g'), ' ')"
_TITLE = f"coalesce({_FLAT.format('list_filter(string_split(text, chr(10)), lambda x: ' + _FLAT.format('x') + chr(32) + '<>' + chr(32) + chr(39) * 2 + ')[1]')}, '')"
_LEAD = "CASE WHEN regexp_extract({0}, '^(.*?[.!?]) ', 1) <> '' THEN regexp_extract({0}, '^(.*?[.!?]) ', 1) ELSE {0} END".format(_FLAT.format("text"))
_KEYWORDS = """
kw0 AS (SELECT doc_id AS id, regexp_extract_all(text, '([A-Za-z][A-Za-z-]{3,})', 1) AS ws FROM documents WHERE text IS NOT NULL),
kw1 AS (SELECT id, unnest(range(len(ws))) AS pos, lower(unnest(ws)) AS word FROM kw0),
kw2 AS (SELECT id, word, min(pos) AS pos FROM kw1 GROUP BY id, word),
kw3 AS (SELECT id, word, row_number() OVER (PARTITION BY id ORDER BY length(word) DESC, pos) AS rn FROM kw2),
kw AS (SELECT id, string_agg(word, ' ' ORDER BY rn) AS keywords FROM kw3 WHERE rn <= 6 GROUP BY id)"""

ORACLES = {
    "smp_uniform": f"WITH {_E} SELECT id FROM e ORDER BY {_draw(11)}, id LIMIT 250",
    "smp_reservoir": f"SELECT doc_id AS id FROM documents ORDER BY {_draw(12, 'doc_id')}, doc_id LIMIT 300",
    "smp_split": f"WITH {_E}, q AS (SELECT id FROM e ORDER BY {_draw(13)}, id LIMIT 120) SELECT id, CASE WHEN id IN (SELECT id FROM q) THEN 'query' ELSE 'fit' END AS role FROM e",
    "smp_split_weighted": f"WITH {_E}, {_C}, q AS (SELECT id FROM w ORDER BY round(-ln(({_draw(14)} + 1) / 4294967297.0::DOUBLE) / weight, 12), id LIMIT 120) SELECT id, CASE WHEN id IN (SELECT id FROM q) THEN 'query' ELSE 'fit' END AS role FROM e",
    "smp_access_weights": f"WITH {_E}, {_C} SELECT id, weight FROM w",
    "smp_cluster_sizes": "SELECT label, count(*) AS rows FROM embeddings GROUP BY label",
    "src_blank_text": f"SELECT source, count(*) AS docs FROM documents WHERE text IS NOT NULL AND {_FLAT.format('text')} <> '' GROUP BY source",
    "src_query_log": "SELECT event_type AS query, props->>'$.k' AS doc_id, count(*) AS uses FROM events GROUP BY 1, 2",
    "src_access_log": "SELECT user_id::VARCHAR AS id, max(event_id)::DOUBLE AS count FROM events GROUP BY 1",
    "syn_title": f"SELECT doc_id AS id, CASE WHEN text IS NOT NULL THEN {_TITLE} END AS title FROM documents",
    "syn_lead": f"SELECT doc_id AS id, {_LEAD} AS lead FROM documents",
    "syn_keywords": f"WITH {_KEYWORDS} SELECT id, keywords FROM kw",
    "syn_queries": f"""WITH {_KEYWORDS}, m AS (SELECT doc_id AS id, substr(CASE WHEN doc_id % 3 = 0 THEN CASE WHEN text IS NOT NULL THEN {_TITLE} END WHEN doc_id % 3 = 1 THEN {_LEAD} ELSE coalesce(kw.keywords, '') END, 1, 200) AS query
FROM documents LEFT JOIN kw ON kw.id = doc_id), r AS (SELECT id, query, row_number() OVER (PARTITION BY lower(query) ORDER BY id) AS rn FROM m WHERE length(query) >= 15)
SELECT id, query FROM r WHERE rn = 1""",
}
