"""Queries of offline statistics and of plain scans with aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from vektrail.operators import metrics, stats
from vektrail.session import table


def stat_wilson(s, d):
    got = table(s, d, "job_items").groupBy("job_id").agg(F.sum((F.col("attempts") > 0).cast("long")).alias("k"), F.count("*").alias("n"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return got.select("job_id", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def stat_clopper_pearson(s, d):
    got = table(s, d, "job_items").groupBy("job_id").agg(F.sum((F.col("attempts") > 0).cast("long")).alias("k"), F.count("*").alias("n"))
    return got.withColumn("ci", stats.clopper_pearson_udf("k", "n")).select("job_id", "k", "n", F.round("ci.low", 6).alias("low"), F.round("ci.high", 6).alias("high"))


def stat_holm(s, d):
    tests = table(s, d, "embeddings").groupBy("label").agg((F.abs(F.avg(F.get("embedding", F.lit(0)).cast("double"))) + 0.001).alias("p")).select(F.col("label").alias("name"), "p")
    return stats.holm(tests).select("name", F.round("p", 6).alias("p"), F.round("adjusted", 6).alias("adjusted"))


def _values(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.get("embedding", F.lit(0)).cast("double").alias("a"), F.get("embedding", F.lit(1)).cast("double").alias("b"), (F.col("label") < 3).alias("s"))


def stat_randomisation(s, d):
    return stats.paired_randomisation(_values(s, d), "a", "b", draws=200, seed=2).select(F.round("observed", 6).alias("observed"), F.round("p", 6).alias("p"))


def stat_selection(s, d):
    return stats.selection_permutation(_values(s, d), "a", "s", draws=200, seed=4).select(F.round("observed", 6).alias("observed"), F.round("p", 6).alias("p"))


def stat_dedupe(s, d):
    rows = table(s, d, "events").select("user_id", "event_type", "event_id", "value")
    return stats.newest_results(rows, ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "event_id")


def met_reindex_cost(s, d):
    n = table(s, d, "documents").count()
    seconds, energy = metrics.reindex_cost(n, 0.0345, 90.0)
    return s.createDataFrame([(n, seconds, round(energy, 6))], "rows long, seconds double, watt_hours double")


def scan_lineitem(s, d):
    """A scan with projection and a pushed filter, aggregated on the map side."""
    rows = table(s, d, "lineitem").where(F.col("l_quantity") > 25)
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("rows"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


QUERIES = {f.__name__: f for f in (stat_wilson, stat_clopper_pearson, stat_holm, stat_randomisation, stat_selection, stat_dedupe, met_reindex_cost, scan_lineitem)}

_Z = stats.Z95
_VALUES = "v AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, label < 3 AS s FROM embeddings)"
ORACLES = {
    "stat_wilson": f"WITH t AS (SELECT job_id, count(*) FILTER (attempts > 0)::DOUBLE AS k, count(*)::DOUBLE AS n FROM job_items GROUP BY job_id) SELECT job_id, round((k / n + {_Z**2} / (2 * n)) / (1 + {_Z**2} / n) - {_Z} * sqrt(k / n * (1 - k / n) / n + {_Z**2} / (4 * n * n)) / (1 + {_Z**2} / n), 6) AS low, round((k / n + {_Z**2} / (2 * n)) / (1 + {_Z**2} / n) + {_Z} * sqrt(k / n * (1 - k / n) / n + {_Z**2} / (4 * n * n)) / (1 + {_Z**2} / n), 6) AS high FROM t",
    "stat_holm": "WITH t AS (SELECT label AS name, abs(avg(embedding[1]::DOUBLE)) + 0.001 AS p FROM embeddings GROUP BY label), r AS (SELECT *, row_number() OVER (ORDER BY p, name) AS rn, count(*) OVER () AS n FROM t) SELECT name, round(p, 6) AS p, round(max(least(1.0, (n - rn + 1) * p)) OVER (ORDER BY p, name), 6) AS adjusted FROM r",
    "stat_randomisation": f"WITH {_VALUES}, o AS (SELECT avg(a - b) AS x FROM v), m AS (SELECT t.b AS draw, avg((v.a - v.b) * (1 - 2 * (('0x' || substr(md5('2|' || t.b || '|' || id), 1, 8))::BIGINT % 2))) AS x FROM v, range(200) t(b) GROUP BY t.b) SELECT round((SELECT x FROM o), 6) AS observed, round((count(*) FILTER (abs(m.x) >= abs((SELECT x FROM o)) - 1e-12) + 1) / 201, 6) AS p FROM m",
    "stat_selection": f"WITH {_VALUES}, o AS (SELECT avg(a) AS x, count(*) AS n FROM v WHERE s), r AS (SELECT t.b AS draw, a, row_number() OVER (PARTITION BY t.b ORDER BY md5('4|' || t.b || '|' || id), id) AS rn FROM v, range(200) t(b)), m AS (SELECT draw, avg(a) AS x FROM r WHERE rn <= (SELECT n FROM o) GROUP BY draw) SELECT round((SELECT x FROM o), 6) AS observed, round((count(*) FILTER (m.x >= (SELECT x FROM o) - 1e-12) + 1) / 201, 6) AS p FROM m",
    "stat_dedupe": "SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY user_id, event_type",
    "met_reindex_cost": "SELECT count(*) AS rows, round(count(*) * 0.0345::DOUBLE, 1) AS seconds, round(round(count(*) * 0.0345::DOUBLE, 1) * 90 / 3600, 6) AS watt_hours FROM documents",
    "scan_lineitem": "SELECT l_returnflag, l_linestatus, count(*) AS rows, round(sum(l_extendedprice), 2) AS price FROM lineitem WHERE l_quantity > 25 GROUP BY 1, 2",
}
