"""Derived inputs of the core queries, with the same definitions for Spark and DuckDB.

``old`` is the table of embeddings; ``new`` is an exact rotation of it (reversed, signs
alternating); ``shear`` adds 0.35 times another element: linear, not orthogonal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vektrail.functions import vec
from vektrail.session import table

DIM = 64


def rotated(v: Column) -> Column:
    """y[i] = (-1)^i * x[63 - i]."""
    return F.transform(F.reverse(vec.doubles(v)), lambda x, i: F.when(i % 2 == 0, x).otherwise(-x))


def sheared(v: Column) -> Column:
    """Unit vector of y[i] = round(x[i] + 0.35 * x[(7 i + 3) mod 64], 6)."""
    v = vec.doubles(v)
    other = F.array(*[F.get(v, F.lit((i * 7 + 3) % DIM)) for i in range(DIM)])
    return vec.l2_normalize(F.zip_with(v, other, lambda x, y: F.round(x + 0.35 * y, 6)))


def old(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), vec.doubles(F.col("embedding")).alias("v"), "label")


def new(spark: SparkSession, sf: str) -> DataFrame:
    return old(spark, sf).withColumn("v", rotated(F.col("v")))


def shear(spark: SparkSession, sf: str) -> DataFrame:
    return old(spark, sf).withColumn("v", sheared(F.col("v")))


IS_QUERY = "id % 5 = 0"  # as text: made before there is a session

SPACES = """
old AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
new AS (SELECT id, label, list_transform(v, lambda x, i: CASE WHEN i % 2 = 1 THEN v[65 - i] ELSE -v[65 - i] END) AS v FROM old),
shear0 AS (SELECT id, label, list_transform(v, lambda x, i: round(x + 0.35 * v[((i - 1) * 7 + 3) % 64 + 1], 6)) AS v FROM old),
shear AS (SELECT id, label, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS v FROM shear0)
"""


def search_sql(name: str, queries: str, docs: str, k: int, mask: bool = False, score: str = "list_dot_product(q.v, d.v)", where: str = "TRUE") -> str:
    """CTE of an exact top-k (query_id, doc_id, score, rank)."""
    keep = "q.id <> d.id" if mask else "TRUE"
    return f"""
{name} AS (SELECT query_id, doc_id, score, rank FROM (
  SELECT q.id AS query_id, d.id AS doc_id, round({score}, 9) AS score,
         row_number() OVER (PARTITION BY q.id ORDER BY round({score}, 9) DESC, d.id) - 1 AS rank
  FROM {queries} q JOIN {docs} d ON {keep} WHERE {where}) WHERE rank < {k})"""


# T1 judgements: same label; grade 2 if the ids are less than 50 apart, else 1; never the query itself
GRADES = """
qrels AS (SELECT q.id AS query_id, d.id AS doc_id, CASE WHEN abs(q.id - d.id) < 50 THEN 2 ELSE 1 END AS grade
  FROM old q JOIN old d ON q.label = d.label AND q.id <> d.id WHERE q.id % 5 = 0)"""


def grades(spark: SparkSession, sf: str) -> DataFrame:
    base = old(spark, sf).select("id", "label")
    q = base.where(IS_QUERY).select(F.col("id").alias("query_id"), "label")
    return q.join(base.withColumnRenamed("id", "doc_id"), "label").where("query_id <> doc_id").select("query_id", "doc_id", F.when(F.abs(F.col("query_id") - F.col("doc_id")) < 50, 2).otherwise(1).alias("grade"))
