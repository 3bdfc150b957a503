"""Queries over the change feed of the job queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vektrail.operators.incremental import instant, replay
from vektrail.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_no, job_id, record_id): what each completed run had to process."""
    feed = table(spark, sf_dir, "job_items").select("job_id", "record_id", "state", "attempts", "updated_utc", "batch_no")
    found = replay(
        feed,
        table(spark, sf_dir, "runs"),
        keys=["job_id", "record_id"],
        seq="batch_no",
        order=[instant(F.col("updated_utc")), F.col("attempts")],
        values={"state": F.lower(F.trim("state")), "attempts": F.col("attempts")},
    )
    return found.select(F.col("run_no").cast("int").alias("run_no"), "job_id", "record_id")


QUERIES = {"p2_found": p2_found}

ORACLES = {
    "p2_found": """
WITH done AS (
  SELECT run_no, max(upto_batch) AS upto FROM runs WHERE lower(trim(state)) = 'completed' GROUP BY run_no),
log AS (
  SELECT run_no, upto, lag(upto) OVER (ORDER BY upto, run_no) AS prior FROM done),
feed AS (
  SELECT job_id, record_id, lower(trim(state)) AS state, attempts, batch_no,
         CAST(CASE WHEN updated_utc IS NULL THEN NULL
              WHEN regexp_matches(updated_utc, '(Z|[+-][0-9]{2}:?[0-9]{2})$')
              THEN regexp_replace(updated_utc, '([+-][0-9]{2})([0-9]{2})$', '\\1:\\2')
              ELSE updated_utc || 'Z' END AS TIMESTAMPTZ) AS at
  FROM job_items),
images AS (
  SELECT l.run_no, f.job_id, f.record_id,
         arg_max(f.state, (coalesce(f.at, TIMESTAMPTZ '0001-01-01 00:00:00+00'), f.attempts, f.state)) AS state,
         max((coalesce(f.at, TIMESTAMPTZ '0001-01-01 00:00:00+00'), f.attempts, f.state)) AS top
  FROM log l JOIN feed f ON f.batch_no <= l.upto GROUP BY 1, 2, 3),
full_images AS (SELECT run_no, job_id, record_id, state, top[2] AS attempts FROM images),
chain AS (SELECT run_no, lag(run_no) OVER (ORDER BY upto, run_no) AS before_no FROM done)
SELECT n.run_no AS run_no, n.job_id AS job_id, n.record_id AS record_id
FROM full_images n JOIN chain c ON c.run_no = n.run_no
LEFT JOIN full_images b ON b.run_no = c.before_no AND b.job_id = n.job_id AND b.record_id = n.record_id
WHERE b.job_id IS NULL OR b.state IS DISTINCT FROM n.state OR b.attempts IS DISTINCT FROM n.attempts
""",
}
