"""The registered queries over whole small tables, against SQL or a plain computation."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from vektrail.llm import encode
from vektrail.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal_to_sql(spark, duck, sf, name):
    df = entry.queries()[name](spark, sf)
    got = duck.execute(ORACLES[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    mine = sorted(tuple(r[c] for c in names) for r in df.collect())
    assert mine == sorted(got.fetchall()) and len(mine) == len(set(mine))


COLUMNS = {
    "p1_found": [("query_id", "bigint"), ("id", "string")],
    "p3_found": [("tab", "string"), ("id_a", "string"), ("id_b", "string")],
    "p4_found": [("tab", "string"), ("cluster_id", "string"), ("id", "string")],
    "p5_found": [("doc_a", "bigint"), ("doc_b", "bigint")],
    "p6_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
    "p7_found": [("source", "string")],
    "p8_found": [("doc_id", "bigint"), ("band", "string")],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_rows(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert name not in COLUMNS or df.dtypes == COLUMNS[name]
    rows = df.collect()
    assert rows and len({repr(r) for r in rows}) == len(rows)


def test_ids_equal_the_plain_encoder(spark, sf):
    plain = encode.codec(f"{encode.TOKENIZERS}/{encode.BYTE_BPE}").encoding
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r.ids for r in QUERIES["p6_ids"](spark, sf).collect()}
    assert got == {i: plain.encode_ordinary(t) if t else [] for i, t in texts.items()}


def test_short_sources_by_hand(spark, sf):
    plain = encode.codec(f"{encode.TOKENIZERS}/{encode.BYTE_BPE}").encoding
    own: dict[str, int] = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        if r.source is not None and r.text:
            key = r.source.strip().lower()
            own[key] = own.get(key, 0) + len(plain.encode_ordinary(r.text))
    targets = spark.read.parquet(f"{sf}/mix_targets.parquet").collect()
    total = sum(own.get(t.source.strip().lower(), 0) for t in targets)
    want = {t.source for t in targets if own.get(t.source.strip().lower(), 0) * t.max_repeats < t.weight * total}
    assert {r.source for r in QUERIES["p7_found"](spark, sf).collect()} == want


def test_levels_agree_with_held_out_labels(spark):
    """Trained on two thirds of the labels, tested on the rest (a few of which are wrong)."""
    from pyspark.sql import functions as F

    from vektrail.llm import reading

    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{folder}/reading_labels.parquet").distinct()
    held = F.col("doc_id") % 3 == 0
    model = reading.train(docs, labels.where(~held))
    got = reading.levelled(docs.join(labels.where(held).select("doc_id"), "doc_id"), model, reading.train_tongues(docs))
    both = labels.where(held).withColumnRenamed("band", "want").join(got, "doc_id")
    assert both.count() > 80 and both.where("band = want").count() / both.count() > 0.88


def test_shares_of_the_mix_reach_their_targets(spark):
    """Sources that are not short get their weight of the tokens that all of these get, within two blocks and their longest document."""
    from vektrail.llm import mixing

    rows = QUERIES["p7_report"](spark, "/root/testdata/sf0.1").collect()
    longest = {r.source: r.m for r in QUERIES["p7_mix"](spark, "/root/testdata/sf0.1").groupBy("source").agg({"tokens": "max"}).toDF("source", "m").collect()}
    full = [r for r in rows if not r.short]
    tokens, weights = sum(r.tokens for r in full), sum(r.weight for r in full)
    grain = sum(r.own_tokens for r in rows) / mixing.BLOCKS
    assert len(full) > 3 and all(abs(r.tokens - tokens * r.weight / weights) <= 2 * grain + longest[r.source] for r in full)
