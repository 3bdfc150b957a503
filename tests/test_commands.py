"""The command line over small tables, and what the commands stand on: versions, samples, probes."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vektrail import cli
from vektrail.operators import ann, audit, sampling, state
from vektrail.operators.incremental import IncrementalReader
from vektrail.session import publish_once


def vectors(spark, n=400, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    return spark.createDataFrame([(i, [float(a) for a in v / np.linalg.norm(v)]) for i, v in enumerate(x)], "id long, v array<double>")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('index')}"
    old = vectors(spark)
    old.write.parquet(f"{path}/old")
    old.withColumn("v", F.reverse("v")).write.parquet(f"{path}/new")
    return path


def said(capsys):
    return json.loads(capsys.readouterr().out.strip().splitlines()[-1])


def test_fit_eval_inspect_and_migrate(spark, folder, capsys):
    old, new, saved, job = f"{folder}/old", f"{folder}/new", f"{folder}/map", f"{folder}/job"
    assert cli.main(["fit", old, new, saved]) == 0 and said(capsys)["held_out_cosine"] == pytest.approx(1.0, abs=1e-3)
    assert cli.main(["eval", saved, old, new]) == 0 and said(capsys)["held_out_cosine"] == pytest.approx(1.0, abs=1e-3)
    assert cli.main(["adapter", "inspect", saved]) == 0 and said(capsys)["dim"] == 8
    assert cli.main(["adapter", "profiles"]) == 0 and "linear" in capsys.readouterr().out
    assert cli.main(["migrate", new, saved, job]) == 0 and said(capsys) == {"done": 400, "failed": 0, "pending": 0, "finished": True}
    assert cli.main(["status", job, new]) == 0 and said(capsys)["done"] == 400
    assert cli.main(["pause", job, new]) == 0 and cli.main(["resume", job, new]) == 0
    assert cli.main(["rollback", job, new, "--out", f"{folder}/back"]) == 0
    back = spark.read.parquet(f"{folder}/back").join(spark.read.parquet(new).withColumnRenamed("v", "w"), "id")
    assert back.count() == 400 and back.where("v <> w").count() == 0
    assert cli.main(["gc", job, new]) == 0


def test_compare_audit_doctor_and_exit_codes(spark, folder, capsys):
    assert cli.main(["compare", f"{folder}/old", f"{folder}/new"]) == 0 and "held_out_cosine" in capsys.readouterr().out
    chain = audit.seal(spark, [{"ts_utc": "2026-01-01", "run_id": "r", "action": "fit"}] * 3)
    chain.write.parquet(f"{folder}/chain")
    chain.where("seq <> 2").write.parquet(f"{folder}/broken")
    assert cli.main(["audit", "verify", f"{folder}/chain"]) == 0 and said(capsys)["broken"] == 0
    assert cli.main(["audit", "verify", f"{folder}/broken"]) == 1
    assert cli.main(["audit", "list", f"{folder}/chain"]) == 0 and cli.main(["audit", "export", f"{folder}/chain", f"{folder}/lines"]) == 0
    assert cli.main(["doctor"]) == 0
    assert cli.main(["fit", f"{folder}/missing", f"{folder}/new", f"{folder}/x"]) == 2
    assert cli.main(["fit", f"{folder}/old", f"{folder}/new", f"{folder}/x", "--kind", "nothing"]) == 2
    spark.read.parquet(f"{folder}/old").limit(5).write.parquet(f"{folder}/few")
    assert cli.main(["fit", f"{folder}/few", f"{folder}/new", f"{folder}/x"]) == 3


def test_a_file_is_published_once(spark, tmp_path):
    path = f"file://{tmp_path}/commits/1"
    assert publish_once(spark, path, b"first") and not publish_once(spark, path, b"second")
    assert (tmp_path / "commits" / "1").read_bytes() == b"first"


def test_versions_of_two_writers(spark, tmp_path):
    one, two = (state.VersionedTable(spark, f"file://{tmp_path}/t") for _ in range(2))
    rows = vectors(spark, 20)
    one.publish(rows)
    seen = two._read()
    one.publish(rows.limit(5))
    two._read = lambda: seen  # started from the first version
    with pytest.raises(RuntimeError):
        two.publish(rows)
    assert one.current().count() == 5


def test_verification_takes_exactly_the_rows_it_should(spark):
    rows = vectors(spark, 300)
    assert state.verify_sample(rows, rows).first().checked == 5
    assert state.verify_sample(rows, rows, share=0.5).first().checked == 150
    assert tuple(state.verify_sample(rows, rows.limit(0)).first()) == (0, None, True)


def test_reader_appends_compacts_and_cleans(spark, tmp_path):
    reader = IncrementalReader(spark, f"file://{tmp_path}/r", ["k"], "n", [F.col("at")], {"s": F.col("s")})
    reader.COMPACT = 2
    feed = lambda rows: spark.createDataFrame(rows, "k string, n int, at int, s string")
    rows, got = [], []
    for n in range(1, 6):
        rows.append(("a" if n % 2 else "b", n, n, f"s{n}"))
        rows.append(("old", n, 0, "same"))
        got.append(sorted(r.k for r in reader.run(feed(rows), n).collect()))
    assert got == [["a", "old"], ["b"], ["a"], ["b"], ["a"]] and len(reader.state()["snaps"]) <= 2
    assert reader.vacuum() >= 2 and reader.run(feed(rows), 9).count() == 0


def test_strata_by_k_means_and_the_whole_draw(spark):
    rows = vectors(spark, 400)
    got = sampling.clustered(rows.unionByName(spark.createDataFrame([(900, None)], "id long, v array<double>")), 8)
    assert got.count() == 401 and got.where("cluster IS NULL").count() == 1 and got.select("cluster").distinct().count() > 4
    for strategy in ("uniform", "stratified", "reservoir"):
        assert sampling.sampled(rows, 250, strategy).count() == 250
    roles = {r.role: r["count"] for r in sampling.drawn(rows, 300, 60, least_fit=200).groupBy("role").count().collect()}
    assert roles == {"query": 60, "fit": 240}
    assert sampling.clustered(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sampling.sampled(rows, 10, "nothing")


def test_quotas_against_their_rule():
    assert sampling.quotas({"a": 100, "b": 50, "c": 0, "d": 1}, 30) == {"a": 19, "b": 10, "c": 0, "d": 1}
    assert sampling.quotas({"a": 3, "b": 3}, 10) == {"a": 3, "b": 3} and sampling.quotas({}, 5) == {} and sampling.quotas({"a": 3}, 0) == {"a": 0}
    for size in range(5, 60):
        got = sampling.quotas({i: n for i, n in enumerate([1, 2, 30, 7, 0, 19])}, size)
        assert sum(got.values()) == min(size, 59) and all(got[i] <= n for i, n in enumerate([1, 2, 30, 7, 0, 19]))


def test_probes_reach_the_wanted_recall(spark):
    rows = vectors(spark, 600)
    index = ann.CellIndex(rows, 8)
    probes, recall = ann.probes_for(index, rows, 0.9, k=5, sample=50)
    assert recall >= 0.9 and 1 <= probes <= 8
