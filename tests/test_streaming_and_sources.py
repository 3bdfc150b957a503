import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from vektrail.plans.fixtures import new, old
from vektrail.plans.models import rotation
from vektrail.sources import logs, stores, uri
from vektrail.streaming.rewrite import Rewrite, bisected


def test_rewrite_pauses_resumes_and_rolls_back(spark, sf, tmp_path):
    index = new(spark, sf).where("id < 60").select("id", F.when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.col("v")).alias("v"))
    job = Rewrite(spark, f"file://{tmp_path}/job", rotation(), index)
    batches = job.prepare(batch_size=20)
    assert batches == 3 and job.prepare() == 3
    first = job.run(most_batches=1)
    assert 0 < first.done < 54 and not first.finished
    job.pause()
    assert job.run().done == first.done
    job.resume()
    last = job.run()
    missing = index.where("v IS NULL").count()
    assert last.done == index.count() - missing and last.pending == missing and last.failed == 0
    got = {r.id: r.v for r in job.current().collect()}
    want = {r.id: r.v for r in old(spark, sf).where("id < 60").collect()}
    assert len(got) == index.count()
    for i, v in want.items():
        assert got[i] is None if i % 11 == 0 else np.allclose(got[i], v, atol=1e-5)
    back = {r.id: r.v for r in job.rolled_back().collect()}
    for r in index.collect():
        assert back[r.id] == r.v


def test_refit_is_taken_only_if_it_helps(spark, sf):
    from vektrail.operators import adapters
    from vektrail.plans.models import pairs
    from vektrail.streaming.rewrite import refitted

    both = pairs(new(spark, sf), old(spark, sf))
    bad = adapters.identity(adapters.Moments.of(both))
    assert refitted(both, bad, "procrustes", least=100).kind == "procrustes" and refitted(both, bad, least=10_000) is bad
    good = rotation()
    assert refitted(both, good, "procrustes", least=100) is good


def test_rewrite_calls_the_refit_hook(spark, sf, tmp_path):
    calls = []
    index = new(spark, sf).where("id < 40").select("id", "v")
    job = Rewrite(spark, f"file://{tmp_path}/hook", rotation(), index, lambda a, left: calls.append(left.count()) or a, refit_every=15)
    job.prepare(batch_size=20)
    assert job.run().finished and len(calls) == 2 and calls[-1] == 0


def test_bisected_isolates_a_poison_row(spark):
    def write(rows):
        if rows.where("id = 7").count():
            raise ValueError("rejected")

    parts = list(bisected(spark.range(40), write))
    assert sum(r.count() for r, _ in parts) == 40
    bad = [r for r, ok in parts if not ok]
    assert len(bad) == 1 and bad[0].where("id = 7").count() == 1 and bad[0].count() < 12


def test_query_log(spark):
    lines = ['{"query": "a", "relevant": ["1", "1", "2"]}', "", "  ", '{"text": "b"}', '{"question": "c", "doc_ids": ["3"]}']
    rows = spark.createDataFrame([(v, i) for i, v in enumerate(lines)], "value string, line long")
    queries, qrels = logs.parse_query_log(rows)
    assert sorted(r.query for r in queries.collect()) == ["a", "b", "c"]
    assert sorted((r.line, r.doc_id) for r in qrels.collect()) == [(0, "1"), (0, "2"), (4, "3")]
    bad = spark.createDataFrame([("not json", 1)], "value string, line long")
    with pytest.raises(Exception, match="malformed log line 1"):
        logs.parse_query_log(bad)[0].collect()
    assert logs.parse_query_log(bad, lenient=True)[0].count() == 0


def test_access_log_last_value_wins(spark):
    rows = spark.createDataFrame([('{"id": "x", "count": 5}', 0), ('{"record_id": "x"}', 1), ('{"id": "y", "count": 2.5}', 2)], "value string, line long")
    assert {r.id: r["count"] for r in logs.parse_access_log(rows).collect()} == {"x": 1.0, "y": 2.5}


def test_addresses(spark):
    rows = spark.createDataFrame([("pgvector://user:pw@host/db?token=abc#docs",), ("",), (None,), ("memory:///x.npz",)], "u string")
    got = uri.parsed(rows, "u").withColumn("safe", uri.redacted(F.col("u"))).collect()
    assert (got[0].scheme, got[0].collection) == ("pgvector", "docs") and "pw" not in got[0].safe and "abc" not in got[0].safe
    assert got[1].scheme is None and got[2].safe is None and got[3].location == "/x.npz"


def test_column_names():
    assert stores.resolve_columns(["uuid", "content", "embedding"]) == ("uuid", "embedding", "content")
    assert stores.resolve_columns(["a", "b"], identity="a", vector="b") == ("a", "b", None)
    with pytest.raises(KeyError):
        stores.resolve_columns(["id", "text"])


def test_archive_sidecar_and_records(spark, tmp_path):
    path = tmp_path / "x.npz"
    np.savez(path, ids=np.array(["a", "b"]), vectors=np.eye(2, dtype="f4"), texts=np.array(["t", "u"]))
    rows = stores.records(stores.read_npz(spark, str(path)))
    assert {r.id: (r.v, r.text) for r in rows.collect()} == {"a": ([1.0, 0.0], "t"), "b": ([0.0, 1.0], "u")}
    assert stores.capabilities(rows).dimension == 2 and stores.capabilities(rows).read_text
    (tmp_path / "meta.json").write_text('{"ids": ["p", "q"]}')
    joined = stores.with_sidecar(spark, spark.createDataFrame([(0, [1.0]), (1, [2.0])], "label long, vector array<float>"), str(tmp_path / "meta.json"))
    assert {r.id: r.vector for r in joined.collect()} == {"p": [1.0], "q": [2.0]}
    text = stores.records(spark.createDataFrame([(1, "[1.5,2]", "m")], "id int, embedding string, kind string"))
    assert text.first().v == [1.5, 2.0] and text.first().metadata == {"kind": "m"}


def test_sqlite_source(spark, tmp_path):
    path = str(tmp_path / "s.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (key TEXT, dim INTEGER, vector BLOB)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?)", [(f"k{i}", 2, np.array([i, 1], "<f4").tobytes()) for i in range(50)] + [("none", None, None)])
        db.execute("CREATE TABLE e (key TEXT)")
    stores.register(spark)
    read = lambda t, s: spark.read.format("sqlite").option("path", path).option("table", t).option("partitions", "3").schema(s).load()
    rows = stores.records(read("t", "key string, dim int, vector binary"))
    assert rows.count() == 51 and rows.where("id = 'k7'").first().v == [7.0, 1.0] and rows.where("id = 'none'").first().v is None
    assert read("e", "key string").count() == 0
