import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vektrail import cli, reports
from vektrail.operators import ann, housekeeping
from vektrail.sources import encoders


def test_memory_sizes():
    assert [housekeeping.memory_size(x) for x in ("512", "64k", "1.5 GB", "2MiB")] == [512, 65_536, 1_610_612_736, 2_097_152]
    with pytest.raises(ValueError):
        housekeeping.memory_size("a lot")


def test_lru_by_hand(spark):
    log = spark.createDataFrame([(i, d) for i, d in enumerate("abacab")], "i int, d string")
    got = housekeeping.lru_hits(log, "d", "i", 2, shards=1).first()
    assert (got.lookups, got.hits) == (6, 2)
    assert housekeeping.lru_hits(log.where("false"), "d", "i", 2).count() == 0
    assert housekeeping.lru_hits(log, "d", "i", 100, shards=1).first().hits == 3


def test_lock_and_listing(spark, tmp_path):
    root = f"file://{tmp_path}"
    with housekeeping.single_writer(spark, root):
        with pytest.raises(RuntimeError), housekeeping.single_writer(spark, root):
            pass
    with housekeeping.single_writer(spark, root):
        pass
    (tmp_path / "rep").mkdir()
    (tmp_path / "rep" / "x.md").write_text("x")
    got = housekeeping.list_files(spark, str(tmp_path), {"rep": "reports"}).where("class = 'reports'").first()
    assert got.length == 1
    assert housekeeping.removable(housekeeping.list_files(spark, str(tmp_path), {"rep": "reports"}), F.current_date()).count() == 0


def test_cells_find_neighbours_and_can_be_rebuilt(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((12, 8))
    rows = spark.createDataFrame([(i, [float(x) for x in base[i % 12] + 0.05 * rng.standard_normal(8)]) for i in range(240)], "id long, v array<double>")
    index = ann.CellIndex(rows, 12)
    assert ann.health(index, rows, k=5, probes=3, sample=60).first().recall > 0.9
    index.rebuild(rows.where("id < 120"))
    assert index.rows.count() == 120 and index.search(rows.where("id = 500"), 3, 2).count() == 0


def test_encoders(spark):
    texts = spark.createDataFrame([(1, "red red door"), (2, None), (3, "")], "key int, text string")
    got = {r.key: r.v for r in encoders.open_encoder("hashing", dim=4)(texts).collect()}
    assert got[2] is None and sum(got[3]) == 0 and abs(sum(x * x for x in got[1]) - 1) < 1e-9
    known = spark.createDataFrame([("red red door", [1.0])], "text string, v array<double>")
    assert encoders.precomputed(texts.where("key = 1"), known).first().v == [1.0]
    with pytest.raises(Exception, match="no vector for key 3"):
        encoders.precomputed(texts.where("key = 3"), known).collect()
    with pytest.raises(KeyError):
        encoders.open_encoder("nothing")
    with pytest.raises(ValueError):
        encoders.register_encoder("hashing", encoders.hashing)
    a, b = encoders.Profile("m", 4), encoders.Profile("m", 5)
    assert a.fingerprint() != b.fingerprint() and encoders.profile_table(spark, [a, b]).count() == 2


def test_reports(spark):
    df = spark.createDataFrame([("a|b", 0.123456, None)], "name string, x double, y int")
    assert "a\\|b" in reports.markdown(df, "t") and "<td>0.1235</td>" in reports.page(df, "t<") and json.loads(reports.as_json(df))[0]["y"] is None
    with pytest.raises(ValueError):
        reports.markdown(spark.range(2_000), "t")


def test_command_line(spark, sf, tmp_path, capsys):
    assert cli.main(["list"]) == 0 and "knn_exact_top10" in capsys.readouterr().out
    assert cli.main(["run", "nothing", sf, "x"]) == 2
    assert cli.main(["report", "vec_dimension", sf, "--json"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])[0]["least"] == 64
