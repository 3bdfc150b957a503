"""Texts under the size of a shingle: p5_groups has one row for every document."""

from pyspark.sql import functions as F

from vektrail.llm import neardup
from vektrail.llm.queries import QUERIES


def test_groups_have_a_row_for_every_document(spark, sf):
    ids = sorted(r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect())
    assert sorted(r.doc_id for r in QUERIES["p5_groups"](spark, sf).collect()) == ids


def test_groups_of_short_and_missing_texts(spark, tmp_path):
    texts = [(1, "red shoes"), (2, "Red  shoes!"), (3, "shoes red"), (4, "red"), (5, None), (6, ""), (7, " \n"), (8, "one two three four"), (9, "one two three four five"), (10, "?!")]
    hot = [(100 + i, "weather today") for i in range(40)]
    spark.createDataFrame([*texts, *hot], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = neardup.p5_groups(spark, str(tmp_path))
    classes = {r.doc_id: r.class_id for r in got.collect()}
    assert classes == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5, 7: 5, 8: 8, 9: 9, 10: 5} | {i: 100 for i, _ in hot}
    assert got.count() == len(texts) + len(hot) and got.where(F.col("links") > 0).count() == 0


def test_longer_texts_keep_the_least_number_of_words(spark):
    docs = spark.createDataFrame([(1, "too short"), (2, None), (3, "just five words in all")], "doc_id long, text string")
    assert {r.doc for r in neardup.similar(docs)[1].collect()} == {3}
