"""Query logs and access logs: one JSON object per line.

Blank lines are skipped. A line that is not an object, or lacks its main field, is an
error that names the line; ``lenient`` reads such lines as absent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: names under which a field may appear, in order of preference
QUERY_NAMES = ("query", "text", "question")
RELEVANT_NAMES = ("relevant", "relevant_ids", "qrels", "doc_ids")
ID_NAMES = ("id", "record_id")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line): the lines of a text file; line numbers grow within the file."""
    return spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line"))


def _parsed(rows: DataFrame, schema: str, main: tuple[str, ...], lenient: bool) -> DataFrame:
    rows = rows.where(F.trim("value") != "").withColumn("_p", F.from_json("value", schema))
    found = F.coalesce(*[F.col(f"_p.{n}") for n in main])
    if lenient:
        return rows.withColumn("_m", found).where(F.col("_m").isNotNull())
    broken = F.raise_error(F.concat(F.lit("malformed log line "), F.col("line").cast("string")))
    return rows.withColumn("_m", F.when(found.isNotNull(), found).otherwise(broken.cast("string")))


def parse_query_log(rows: DataFrame, lenient: bool = False) -> tuple[DataFrame, DataFrame]:
    """Queries (line, query) and judgements (line, doc_id), from rows (value, line)."""
    schema = ", ".join([*(f"{n} string" for n in QUERY_NAMES), *(f"{n} array<string>" for n in RELEVANT_NAMES)])
    good = _parsed(rows, schema, QUERY_NAMES, lenient)
    relevant = F.coalesce(*[F.col(f"_p.{n}") for n in RELEVANT_NAMES], F.array().cast("array<string>"))
    return good.select("line", F.col("_m").alias("query")), good.select("line", F.explode(F.array_distinct(relevant)).alias("doc_id"))


def parse_access_log(rows: DataFrame, lenient: bool = False) -> DataFrame:
    """(id, count): the last count of each id, 1 where a line has none."""
    schema = ", ".join([*(f"{n} string" for n in ID_NAMES), "count double"])
    good = _parsed(rows, schema, ID_NAMES, lenient)
    return good.groupBy(F.col("_m").alias("id")).agg(F.max_by(F.coalesce("_p.count", F.lit(1.0)), "line").alias("count"))


def judged(qrels: DataFrame) -> bool:
    """Whether any query has a relevant document."""
    return not qrels.isEmpty()
