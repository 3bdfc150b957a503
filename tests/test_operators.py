import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vektrail.functions import vec
from vektrail.operators import adapters, audit, decision, knn, metrics, sampling, serving, state, stats, truncation


def rows(spark, data, schema="id long, v array<double>"):
    return spark.createDataFrame(data, schema)


def ranked(spark, lists):
    return rows(spark, [(q, d, n, 1.0 - n / 10) for q, ds in lists.items() for n, d in enumerate(ds)], "query_id long, doc_id long, rank int, score double")


def qrels(spark, data):
    return rows(spark, data, "query_id long, doc_id long, grade int")


def value(df):
    return df.first()[0]


def test_vector_functions_on_edges(spark):
    df = rows(spark, [(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, None), (3, [])])
    got = {r.id: (r.n, r.p, r.q, r.b) for r in df.select("id", vec.l2_normalize(F.col("v")).alias("n"), vec.pad_or_truncate(F.col("v"), 3).alias("p"), vec.quantize_int8(F.col("v")).alias("q"), vec.quantize_binary(F.col("v")).alias("b")).collect()}
    assert got[0] == ([0.6, 0.8], [3.0, 4.0, 0.0], pytest.approx([95 / 127 * 4, 4.0]), [1.0, 1.0])
    assert got[1] == ([0.0, 0.0], [0.0] * 3, [0.0, 0.0], [1.0, 1.0])
    assert got[2] == (None, None, None, None) and got[3] == ([], [0.0] * 3, [], [])
    assert rows(spark, [(0, [1.0, 2.0])]).select(vec.truncate(F.col("v"), 5).alias("v")).first().v == [1.0, 2.0]


def test_top_k_edges(spark):
    docs = rows(spark, [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (None, [1.0, 0.0]), (5, [])])
    q = rows(spark, [(1, [1.0, 0.0]), (9, [0.0, 2.0])])
    got = [(r.query_id, r.doc_id, r.rank) for r in knn.top_k(q, docs, 10).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (9, 3, 0), (9, 1, 1), (9, 2, 2)]
    assert [r.doc_id for r in knn.top_k(q, docs, 0, self_mask=True).orderBy("query_id").collect()] == [2, 3]
    none = docs.where("false")
    assert knn.top_k(none, docs, 3).count() == 0 and knn.top_k(q, none, 3).count() == 0
    with pytest.raises(KeyError):
        knn.require_known(rows(spark, [(99, None)]), docs)


def test_block_kernel_equals_sql_and_grid(spark, monkeypatch):
    rng = np.random.default_rng(1)
    docs = rows(spark, [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(300)])
    q = docs.where("id % 7 = 0")
    key = lambda df: sorted((r.query_id, r.doc_id, r.rank, round(r.score, 6)) for r in df.collect())
    block = key(knn.top_k(q, docs, 5, self_mask=True))
    monkeypatch.setattr(knn, "BROADCAST_BYTES", 0)
    assert key(knn.top_k(q, docs, 5, self_mask=True)) == block


def test_metrics_by_hand(spark):
    got = ranked(spark, {1: [10, 11, 12], 2: [20, 21, 22]})
    rel = qrels(spark, [(1, 11, 2), (1, 12, 1), (1, 99, 1), (2, 77, 1), (3, 5, 0)])
    assert {r.query_id: r.recall for r in metrics.recall_per_query(got, rel, 3).collect()} == {1: pytest.approx(2 / 3), 2: 0.0}
    assert {r.query_id: r.rr for r in metrics.mrr(got, rel, 3).collect()} == {1: 0.5, 2: 0.0}
    ideal = 2 + 1 / math.log2(3) + 1 / 2
    want = (2 / math.log2(3) + 1 / 2) / ideal
    assert {r.query_id: r.ndcg for r in metrics.ndcg_per_query(got, rel, 3).collect()} == {1: pytest.approx(want), 2: 0.0}
    empty = qrels(spark, [])
    assert math.isnan(value(metrics.mean_of(metrics.recall_per_query(got, empty, 3), "recall"))) and value(metrics.mean_of(metrics.ndcg_per_query(got, empty, 3), "ndcg", 0.0)) == 0
    assert metrics.overlap_per_query(got, ranked(spark, {1: [12, 50]}), 3).where("query_id = 1").first().overlap == pytest.approx(1 / 3)
    assert value(metrics.candidate_reuse(ranked(spark, {1: [1, 2], 2: [1, 3]}), 2)) == pytest.approx(0.25)
    assert metrics.spearman_per_query(ranked(spark, {1: [1, 2, 3]}), ranked(spark, {1: [3, 2, 1]}), 3).first().rho == pytest.approx(-1.0)
    assert value(metrics.ks_distance(got, got)) == 0
    assert tuple(metrics.bootstrap(rows(spark, [], "query_id long, recall double"), "recall")) == () or metrics.bootstrap(rows(spark, [], "query_id long, recall double"), "recall").first().low is None
    assert metrics.bootstrap(rows(spark, [(1, 1.0), (2, 1.0)], "query_id long, x double"), "x", draws=20).first().low == 1.0
    assert value(metrics.tail_recall(rows(spark, [(1, 1.0)], "query_id long, recall double"), rows(spark, [(1, 0)], "query_id long, cluster int"))) is None
    assert metrics.reindex_cost(10, 0.01) == (0.1, None)


def test_quotas_and_sampling(spark):
    assert sampling.quotas({"a": 1, "b": 0, "c": 100}, 10) == {"a": 1, "b": 0, "c": 9}
    assert sum(sampling.quotas({i: i for i in range(20)}, 57).values()) == 57 and sampling.quotas({"a": 3}, 99) == {"a": 3}
    assert sampling.quotas({}, 5) == {} and sampling.cluster_count(1) == 8 and sampling.cluster_count(10**6) == 64
    base = spark.range(1_000).withColumn("c", F.when(F.col("id") < 700, 0).otherwise(F.col("id") % 3 + 1)).withColumn("w", (F.col("id") % 2).cast("double"))
    assert sampling.stratified(base, 100, "c").count() == 100 and sampling.stratified(base, 60, "c", weight="w").where("w = 0").count() == 0
    parts = sampling.split(base, 300).groupBy("role").count().collect()
    assert {r.role: r["count"] for r in parts} == {"query": 300, "fit": 700}
    with pytest.raises(ValueError):
        sampling.uniform(base.limit(10), 5)
    with pytest.raises(ValueError):
        sampling.split(base.limit(250), 100)


@pytest.mark.parametrize("kind", ["procrustes", "procrustes_centered", "linear"])
def test_fits_recover_a_rotation(spark, kind):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((200, 6))
    r = np.linalg.qr(rng.standard_normal((6, 6)))[0]
    shift = 0.3 if kind != "procrustes" else 0.0
    pairs = spark.createDataFrame([([*map(float, a)], [*map(float, a @ r + shift)]) for a in x], "src array<double>, dst array<double>")
    m = adapters.Moments.of(pairs)
    fitted = adapters.FITS[kind](m)
    assert np.allclose(fitted.apply(x), x @ r + shift, atol=1e-2 if kind == "linear" else 1e-8)
    scaled = adapters.scaled(fitted, m)
    p, t = fitted.apply(x), x @ r + shift
    assert np.allclose(scaled.apply(x), p * ((p * t).sum(0) / (p * p).sum(0)), atol=1e-8)
    a, b = x @ x.T, (x @ r + shift) @ (x @ r + shift).T
    off = ~np.eye(200, dtype=bool)
    assert m.geometry()[0] == pytest.approx(math.sqrt(((a - b)[off] ** 2).mean()), abs=1e-6)


def test_fit_inputs_and_artefact(spark, tmp_path):
    few = spark.createDataFrame([([1.0], [1.0])], "src array<double>, dst array<double>")
    with pytest.raises(ValueError):
        adapters.Moments.of(few)
    bad = spark.createDataFrame([([float("nan"), 1.0], [1.0])] * 40, "src array<double>, dst array<double>")
    with pytest.raises(ValueError):
        adapters.Moments.of(bad)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((80, 8))
    narrow = spark.createDataFrame([([*map(float, a)], [*map(float, a[:5])]) for a in x], "src array<double>, dst array<double>")
    m = adapters.Moments.of(narrow)
    for kind in adapters.FITS:
        assert adapters.FITS[kind](m).apply(x).shape == (80, 5)
    mlp = adapters.residual_mlp(narrow, m, hidden=8, epochs=2)
    mlp.save(spark, f"file://{tmp_path}/a", evaluation={"arr": 1.0})
    assert np.allclose(adapters.Adapter.load(spark, f"file://{tmp_path}/a").apply(x), mlp.apply(x))
    both = adapters.chained(adapters.identity(m), adapters.identity(m))
    assert np.allclose(both(x)[:, :5], x[:, :5])


def test_selection_prefers_the_smaller_map(spark):
    table = spark.createDataFrame([("big", 0.90, 100), ("small", 0.897, 10), ("poor", 0.5, 1)], "name string, score double, n_params int")
    assert adapters.select_best(table).first().name == "small"


def hits(spark, data):
    return rows(spark, data, "query_id long, id long, score double, rank int")


def test_fusion_and_cascade(spark):
    a, b = hits(spark, [(1, 10, 0.9, 0), (1, 11, 0.8, 1)]), hits(spark, [(1, 11, 3.0, 0), (1, 12, 2.0, 1)])
    order = lambda df: [r.id for r in df.orderBy("rank").collect()]
    assert order(serving.rrf(a, b)) == order(serving.rrf(b, a)) == [11, 10, 12]
    assert order(serving.calibrated_merge(a, b, None)) == [11, 10, 12]
    flat = adapters.Calibrator((0.0, 1.0), (0.0, 10.0))
    assert order(serving.calibrated_merge(a, b, flat)) == [10, 11, 12]
    q = rows(spark, [(1, [1.0, 0.0])])
    fresh = rows(spark, [(10, [0.0, 1.0]), (12, [1.0, 0.0]), (13, [1.0, 0.1])])
    first = hits(spark, [(1, 10, 0.9, 0), (1, 11, 0.8, 1), (1, 12, 0.7, 2), (1, 13, 0.6, 3)])
    assert order(serving.cascade(first, q, fresh, 4)) == [12, 11, 13, 10]
    assert serving.side_depth(10, 0, 100, True) == 10 and serving.side_depth(10, 5, 100, True) == 80 and serving.side_depth(10, 50, 100, False) == 21


def test_upsert_cache_and_versions(spark, tmp_path):
    base = rows(spark, [(1, [1.0]), (2, [2.0])])
    got = {r.id: r.v for r in state.upsert(base, rows(spark, [(2, [9.0]), (3, [3.0]), (2, [8.0])])).collect()}
    assert got == {1: [1.0], 2: [9.0]}
    table = state.VersionedTable(spark, f"file://{tmp_path}/t")
    table.publish(base)
    table.publish(state.upsert(base, rows(spark, [(1, [5.0])])))
    assert {r.id: r.v for r in table.current().collect()} == {1: [5.0], 2: [2.0]}
    table.roll_back(base)
    assert {r.id: r.v for r in table.current().collect()} == {1: [1.0], 2: [2.0]}
    keys = rows(spark, [("a",), ("a",), ("b",), (None,)], "key string")
    cache = rows(spark, [("a", [1.0])], "key string, v array<double>")
    assert [r.key for r in state.missing_in_cache(keys, cache).collect()] == ["b"]
    texts = rows(spark, [("a", "x"), ("b", "y"), ("b", "y")], "key string, text string")
    made, full = state.cached_encode(texts, cache, lambda m: m.select("key", F.array(F.lit(7.0)).alias("v")))
    assert made.count() == 3 and full.count() == 2
    assert not state.verify_sample(base.where("id = 1"), base, share=1.0).first().ok and state.verify_sample(base, base, share=1.0).first().ok


def test_audit_chain(spark):
    chain = audit.seal(spark, [{"ts_utc": f"2026-01-0{i}", "run_id": "r", "action": "fit", "inputs": {"b": 1, "a": None}} for i in range(1, 5)])
    assert tuple(audit.verify(chain).first()) == (4, 0, None) and tuple(audit.verify(chain.where("false")).first()) == (0, 0, None)
    assert audit.verify(chain.where("seq <> 2")).first().first_broken == 3
    assert audit.export(chain).count() == 4 and audit.canonical({"b": 1, "a": "é"}) == '{"a":"é","b":1}'


def test_statistics(spark):
    low, high = stats.clopper_pearson(5, 10)
    assert (round(low, 4), round(high, 4)) == (0.1871, 0.8129) and stats.clopper_pearson(0, 10)[0] == 0 and stats.clopper_pearson(10, 10)[1] == 1
    assert stats.binomial_test(5, 10) == pytest.approx(1.0) and stats.binomial_test(0, 10) == pytest.approx(2 / 1024)
    got = {r.name: r.adjusted for r in stats.holm(rows(spark, [("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "name string, p double")).collect()}
    assert got == {"a": pytest.approx(0.03), "b": pytest.approx(0.06), "c": pytest.approx(0.06)}


def test_cells_and_decision_order(spark):
    assert truncation.cells(64, [128, 64, 16], ["int8"]) == [(64, "int8"), (16, "int8")] and truncation.storage(32, 64, "int8") == 0.125
    names = "name string, gain double"
    assert [r.name for r in decision.ordered(rows(spark, [("a", None), ("b", 1.0), ("c", 2.0)], names)).collect()] == ["c", "b", "a"]
    assert decision.survivors(rows(spark, [("a", None), ("b", None)], names)).count() == 2
