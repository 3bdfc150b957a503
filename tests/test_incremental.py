import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vektrail.operators.incremental import IncrementalReader, Intervals, available, instant, plan_runs, replay

FEED = "job_id string, record_id string, state string, attempts int, updated_utc string, batch_no int, run_no int, image string, _pos int"
RUNS = "run_no int, state string, upto_batch int, finished_utc timestamp"


def feed(spark, rows):
    """Extra columns clash with the operator's own names."""
    return spark.createDataFrame([(*r, 0, "x", 0) for r in rows], FEED)


def found(spark, rows, runs):
    got = replay(
        feed(spark, rows),
        spark.createDataFrame([(*r, None) for r in runs], RUNS),
        ["job_id", "record_id"], "batch_no", [instant(F.col("updated_utc")), F.col("attempts")],
        {"state": F.lower(F.trim("state")), "attempts": F.col("attempts")},
    )
    return sorted((r.run_no, r.job_id, r.record_id) for r in got.collect())


spans = st.lists(st.tuples(st.integers(0, 40), st.integers(0, 8)).map(lambda t: (t[0], t[0] + t[1])), max_size=8)


@settings(max_examples=200, deadline=None)
@given(spans, spans)
def test_intervals_behave_like_sets(a, b):
    as_set = lambda x: {i for lo, hi in x.spans for i in range(lo, hi + 1)}
    x, y = Intervals.of(a), Intervals.of(b)
    assert as_set(x.union(y)) == as_set(x) | as_set(y) and as_set(x.minus(y)) == as_set(x) - as_set(y)
    assert all(p[1] + 1 < q[0] for p, q in zip(x.spans, x.spans[1:], strict=False))


def test_plan_gives_each_number_to_one_run():
    plan = plan_runs(Intervals.of([(1, 3), (6, 9)]), [(7, 8), (2, 2), (5, 8), (1, 20)])
    assert [(run, gap.spans) for _, run, gap in plan] == [(2, ((1, 2),)), (5, ((3, 3), (6, 8))), (7, ()), (1, ((9, 9),))]


def test_instants(spark):
    texts = ["2026-02-01T10:00:00Z", "2026-02-01 10:00:00", "2026-02-01T12:00:00+02:00", "2026-02-01T05:00:00-0500", "2026-02-01T10:00:00.000000+0000", " 2026-02-01t10:00:00z ", "", "rubbish", None]
    got = [r.t for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").orderBy("i").select(instant(F.col("x")).cast("long").alias("t")).collect()]
    assert len(set(got[:6])) == 1 and got[6:] == [None, None, None]


def test_replay_cases(spark):
    rows = [
        ("j", "a", "pending", 0, "2026-02-01T00:00:00Z", 1),
        ("j", "a", " DONE ", 0, "2026-02-02T00:00:00Z", 2),
        ("j", "a", "done", 0, "2026-02-03T00:00:00Z", 4),  # only its time changed
        ("j", "b", "pending", 0, None, 1),
        ("j", "b", "failed", 1, "2026-01-01T00:00:00Z", 3),  # any time is newer than none
        ("j", "c", "done", 1, "2026-02-05T00:00:00Z", 1),
        ("j", "c", "failed", 2, "2026-02-04T00:00:00+00:00", 4),  # late and older
        ("j", "d", None, 0, "2026-02-01T00:00:00Z", 4),
        ("j", "e", "done", 0, "2026-02-01T00:00:00Z", 9),  # beyond every run
        ("j", "f", "done", 0, "2026-02-01T00:00:00Z", None),
        ("j", "a", "pending", 0, "2026-02-01T00:00:00Z", 1),
    ]
    runs = [(1, "completed", 1), (2, "failed", 2), (3, " Completed", 3), (4, "completed", 4), (4, "completed", 4), (5, "running", 9), (6, "completed", None)]
    assert found(spark, rows, runs) == [(1, "j", "a"), (1, "j", "b"), (1, "j", "c"), (3, "j", "a"), (3, "j", "b"), (4, "j", "d")]
    assert found(spark, [], runs) == [] and found(spark, rows, []) == []


def test_reader_survives_failures_and_late_batches(spark, tmp_path):
    reader = IncrementalReader(spark, f"file://{tmp_path}/r", ["record_id"], "batch_no", [instant(F.col("updated_utc"))], {"state": F.col("state")})
    rows = [("j", "a", "p", 0, "2026-02-01T00:00:00Z", 1), ("j", "b", "p", 0, "2026-02-01T00:00:00Z", 3)]
    names = lambda df: sorted(r.record_id for r in df.collect())
    assert names(reader.run(feed(spark, rows), 3)) == ["a", "b"]
    rows += [("j", "c", "p", 0, "2026-02-02T00:00:00Z", 2), ("j", "a", "d", 0, "2026-02-03T00:00:00Z", 4)]  # batch 2 comes late
    with pytest.raises(RuntimeError):
        reader.run(feed(spark, rows), 4, fail_before_commit=True)
    assert names(reader.run(feed(spark, rows), 4)) == ["a", "c"]
    assert names(reader.run(feed(spark, rows), 4)) == []
    assert reader.state()["intervals"] == [[1, 4]] and available(feed(spark, rows), "batch_no").spans == ((1, 4),)
