"""Queries made from texts: title, first sentence and keywords.

White space is the ASCII class, so that other SQL engines agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LONGEST, SHORTEST, KEYWORDS = 200, 15, 6  # fixed values: characters of a query, words of a keyword query


def flat(text: Column) -> Column:
    """White space collapsed to single blanks and trimmed."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))


def title(text: Column) -> Column:
    """First line that is not blank; empty if there is none, null for null."""
    lines = F.filter(F.split(text, r"\n"), lambda x: flat(x) != "")
    return F.when(text.isNotNull(), F.coalesce(flat(F.get(lines, F.lit(0))), F.lit("")))


def lead(text: Column) -> Column:
    """Text up to the first end of a sentence followed by a blank; all of it if there is none."""
    whole = flat(text)
    first = F.regexp_extract(whole, r"^(.*?[.!?]) ", 1)
    return F.when(first != "", first).otherwise(whole)


def blank(text: Column) -> Column:
    return text.isNull() | (flat(text) == "")


def keywords(docs: DataFrame, key: str, text: str, top: int = KEYWORDS) -> DataFrame:
    """(key, keywords): the ``top`` longest distinct ASCII words, first seen first among equal lengths."""
    words = docs.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit("([A-Za-z][A-Za-z-]{3,})"), 1)).alias("pos", "word"))
    first = words.groupBy(key, F.lower("word").alias("word")).agg(F.min("pos").alias("pos"))
    best = first.withColumn("rn", F.row_number().over(W.partitionBy(key).orderBy(F.desc(F.length("word")), "pos"))).where(F.col("rn") <= top)
    return best.groupBy(key).agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("rn", "word"))), lambda x: x.word)).alias("keywords"))


def queries(docs: DataFrame, key: str, text: str, limit: int | None = None) -> DataFrame:
    """(key, query): one query per document from its title, lead or keywords in turn.

    Which form a document gives depends on key modulo 3. Queries are cut at 200
    characters; under 15 they are dropped; of equal ones, whatever their case, the
    smallest key stays.
    """
    base = docs.select(key, text).join(keywords(docs, key, text), key, "left")
    form = F.pmod(F.col(key), F.lit(3))
    made = F.when(form == 0, title(F.col(text))).when(form == 1, lead(F.col(text))).otherwise(F.coalesce("keywords", F.lit("")))
    cut = base.select(key, F.substring(made, 1, LONGEST).alias("query")).where(F.length("query") >= SHORTEST)
    one = cut.groupBy(F.lower("query").alias("_l")).agg(F.min_by(F.struct(key, "query"), key).alias("m")).select("m.*")
    return one if limit is None else one.orderBy(key).limit(limit)
