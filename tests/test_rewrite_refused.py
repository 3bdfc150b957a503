"""Rows whose write is refused: the run goes on, and only they are marked failed."""

from pyspark.sql import functions as F

from vektrail.plans.fixtures import new
from vektrail.plans.models import rotation
from vektrail.streaming.rewrite import Rewrite


class Refusing(Rewrite):
    """A store that takes no batch with id 7."""

    def _store(self, rows, path):
        if rows.where("id = 7").count():
            raise OSError("rejected")
        super()._store(rows, path)


def states(job):
    return {r.id: r.state for r in job.items().collect()}


def test_one_poison_row_fails_only_its_part(spark, sf, tmp_path):
    index = new(spark, sf).where("id < 60").select("id", "v")
    job = Refusing(spark, f"file://{tmp_path}/job", rotation(), index)
    assert job.prepare(batch_size=20) == 3
    outcome = job.run()
    total = index.count()
    assert outcome.finished and outcome.pending == 0 and outcome.done + outcome.failed == total and 1 <= outcome.failed <= 6
    got = states(job)
    assert got[7] == "failed"
    rows = [(r.id, tuple(r.v)) for r in job.current().collect()]
    assert len(rows) == len({i for i, _ in rows}) == total
    before = {r.id: tuple(r.v) for r in index.collect()}
    assert all((v == before[i]) == (got[i] == "failed") for i, v in rows)


def test_a_vector_of_another_width_is_refused_alone(spark, sf, tmp_path):
    index = new(spark, sf).where("id < 20").select("id", F.when(F.col("id") == 7, F.slice("v", 1, 3)).otherwise(F.col("v")).alias("v"))
    job = Rewrite(spark, f"file://{tmp_path}/width", rotation(), index)
    job.prepare(batch_size=20)
    outcome = job.run()
    assert outcome.finished and states(job)[7] == "failed" and outcome.done >= 14


def test_repeated_batch_replaces_parts_of_an_earlier_attempt(spark, sf, tmp_path):
    index = new(spark, sf).where("id < 20").select("id", "v")
    job = Rewrite(spark, f"file://{tmp_path}/again", rotation(), index)
    job.prepare(batch_size=20)
    index.write.parquet(f"file://{tmp_path}/again/out/batch=0_2")
    assert job.run().done == index.count()
    assert job.current().count() == index.count() and spark.read.parquet(f"file://{tmp_path}/again/out").count() == index.count()


def test_nothing_written(spark, sf, tmp_path):
    index = new(spark, sf).where("id = 7").select("id", "v")
    job = Refusing(spark, f"file://{tmp_path}/none", rotation(), index)
    job.prepare()
    outcome = job.run()
    assert outcome.failed == 1 and outcome.finished and job.current().count() == 1
