"""Nulls, empty tables, odd texts, ties, repeated rows and clashing columns of every operator of the package."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vektrail.llm import clusters, encode, fusion, mixing, neardup, neighbors, reading
from vektrail.llm.vectors import DIM, Table, current_documents

HITS = "query_id long, side string, id string, score double, rank int, searched_utc timestamp"
SIDES = "side string, higher_is_better boolean, first_rank int"


def hits(spark, rows):
    return spark.createDataFrame([(*r, None) for r in rows], HITS)


def sides(spark):
    return spark.createDataFrame([("a", True, 0), ("b", False, 1), ("c", True, 1)], SIDES)


def test_fusion_empty_and_nulls(spark):
    assert fusion.ranked(hits(spark, []), sides(spark)).count() == 0
    rows = [(1, "a", "x", None, None), (None, "a", "x", 1.0, 0), (1, None, "x", 1.0, 0), (1, "a", None, 1.0, 0)]
    assert fusion.ranked(hits(spark, rows), sides(spark)).count() == 0


def test_fusion_directions_missing_scores_and_repeats(spark):
    rows = [(1, "a", "x", 9e6, 0), (1, "a", "y", 5.0, 1), (1, "a", "z", 1.0, 2), (1, "a", "z", 1.0004, 2)]
    rows += [(1, "b", "y", 0.1, 1), (1, "b", "x", float("nan"), 2), (1, "b", "z", 0.9, None)]
    got = fusion.ranked(hits(spark, rows), sides(spark)).orderBy("place").collect()
    assert [r.id for r in got] == ["x", "y", "z"] or [r.id for r in got] == ["y", "x", "z"]
    assert len(got) == 3 and all(0 < r.score < 1 for r in got)


def test_fusion_absent_item_stands_last_and_ties_go_by_id(spark):
    rows = [(1, s, i, v, None) for s in ("a", "c") for i, v in (("m", 3.0), ("n", 3.0), ("o", 1.0))] + [(1, "a", "lone", 2.0, None)]
    got = [r.id for r in fusion.ranked(hits(spark, rows), sides(spark)).orderBy("place").collect()]
    assert got[:2] == ["m", "n"]
    one = fusion.ranked(hits(spark, [(7, "a", "p", 4.0, 0), (7, "a", "q", 4.0, 1)]), sides(spark)).orderBy("place").collect()
    assert [r.id for r in one] == ["p", "q"] and one[0].score == one[1].score


def test_fusion_far_scores_and_absent_items_keep_their_order(spark):
    """Scores far above a tight list stay apart, and an absent item stands behind the last one of a list with an outlier."""
    tight = [(1, "a", f"t{i}", 1.0 + i * 1e-3, None) for i in range(9)]
    got = [r.id for r in fusion.ranked(hits(spark, [*tight, (1, "a", "z9", 9.0, None), (1, "a", "m5", 5.0, None)]), sides(spark)).orderBy("place").collect()]
    assert got[:2] == ["z9", "m5"]
    rows = [*tight, (1, "a", "worst", -1e5, None)] + [(1, "c", i, 1.0, None) for i in ("worst", "lone")]
    got = [r.id for r in fusion.ranked(hits(spark, rows), sides(spark)).orderBy("place").collect()]
    assert got.index("worst") < got.index("lone")


def test_fusion_repeated_hits_of_a_falling_side_take_the_better_score(spark):
    rows = [(1, "b", "x", 0.1, 1), (1, "b", "x", 0.9, 1), (1, "b", "y", 0.5, 2)]
    assert [r.id for r in fusion.ranked(hits(spark, rows), sides(spark)).orderBy("place").collect()] == ["x", "y"]


def test_fusion_places_of_a_long_query(spark):
    rows = hits(spark, [(1, "a", f"i{i:04d}", float(i // 3), None) for i in range(900)])
    got = fusion.ranked(rows, sides(spark)).orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, 901))
    assert [r.id for r in got] == [f"i{i:04d}" for i in sorted(range(900), key=lambda i: (-(i // 3), i))]


def test_fusion_fills_across_rank_buckets(spark):
    known = [(1, "a", f"k{i:05d}", float(-i), i) for i in (0, 4_095, 4_096, 9_000)]
    rows = hits(spark, [*known, (1, "a", "hole", None, 6_548), (1, "a", "end", None, 9_500), (1, "a", "edge", None, 4_095)])
    got = {r.id: r.s for r in fusion.filled(fusion.clean_hits(rows, sides(spark))).collect()}
    assert got["hole"] == pytest.approx(-6_548) and got["end"] == -9_000 and got["edge"] == -4_095


def test_fusion_list_without_scores_uses_ranks(spark):
    got = [r.id for r in fusion.ranked(hits(spark, [(1, "a", i, None, n) for n, i in enumerate("cab")]), sides(spark)).orderBy("place").collect()]
    assert got == ["c", "a", "b"]


def test_fusion_weights(spark):
    rows = [(1, "a", "x", 9.0, 0), (1, "a", "y", 1.0, 1), (1, "c", "y", 9.0, 1), (1, "c", "x", 1.0, 2)]
    for heavy, best in (("a", "x"), ("c", "y")):
        assert fusion.ranked(hits(spark, rows), sides(spark), {heavy: 5.0}).where("place = 1").first().id == best


def blob(v):
    return np.asarray(v, "<f4").tobytes()


def vectors(spark, rows):
    return Table("vectors", spark.createDataFrame(rows, "id string, raw binary"))


def axis(i, scale=1.0):
    v = np.zeros(DIM)
    v[i] = scale
    return v


def near(i, j, share):
    return axis(i) * math.sqrt(1 - share) + axis(j) * math.sqrt(share)


def odd_vectors():
    return [("null", None), ("short", blob([1.0])), ("zero", blob(axis(0) * 0)), ("nan", blob(axis(0) * float("nan"))), ("inf", blob(axis(0, float("inf"))))]


def test_neighbors_odd_vectors_and_empty(spark):
    for rows in ([], odd_vectors()):
        assert neighbors.similar_pairs(vectors(spark, rows)).count() == 0
        assert clusters.clusters(vectors(spark, rows)).count() == 0


def test_neighbors_copies_in_order_of_ids(spark):
    rows = [(f"c{i}", blob(axis(0))) for i in range(9)] + [("c3", blob(axis(0))), ("n", blob(near(0, 1, 0.1))), ("far", blob(axis(5)))] + odd_vectors()
    got = {(r.id_a, r.id_b) for r in neighbors.similar_pairs(vectors(spark, rows)).collect()}
    want = set()
    ids = [f"c{i}" for i in range(9)]
    for me in ids:
        for other in [x for x in ids if x != me][:5]:
            want.add((min(me, other), max(me, other)))
    want |= {(c, "n") for c in ids[:5]}
    assert got == want


def test_clusters_chain_copies_and_sizes(spark):
    step = [np.cos(a) * axis(0) + np.sin(a) * axis(1) for a in np.arange(6) * 0.5]  # neighbours at cosine 0.878, others below
    rows = [(f"chain{i}", blob(v * (i + 1))) for i, v in enumerate(step)]
    rows += [(f"copy{i}", blob(axis(9))) for i in range(3)] + [("two0", blob(axis(12))), ("two1", blob(near(12, 13, 0.1))), ("copy1", blob(axis(9)))] + odd_vectors()
    source = vectors(spark, rows)
    got = clusters.clusters(source)
    named = got.join(clusters.of_size(got), "label")
    members = {}
    for r in named.collect():
        members.setdefault(r.cluster_id, set()).add(r.id)
    assert members == {"chain0": {f"chain{i}" for i in range(6)}, "copy0": {"copy0", "copy1", "copy2"}}
    typical = {(r.cluster_id, r.place): (r.id, r.affinity, r.size) for r in clusters.typical(source, got).collect()}
    assert typical["copy0", 1] == ("copy0", 1.0, 3) and typical["chain0", 1][0] in ("chain2", "chain3") and ("chain0", 4) not in typical


def chain(spark, n):
    """Pieces e0 .. en in a chain, and two more that share a vector."""
    rows = [(f"h{i:02d}", f"e{j:02d}") for i in range(n) for j in (i, i + 1)] + [("x", "y"), ("z", "y"), ("z", "yy"), ("w", "yy")]
    return spark.createDataFrame([(bytearray(a.encode()), bytearray(b.encode()), 0.9) for a, b in rows], clusters.INCIDENCE)


def test_long_chains_of_pieces_are_joined_level_by_level(spark):
    labels = {bytes(r.h).decode(): bytes(r.label) for r in clusters.assign(chain(spark, 24)).collect()}
    assert len({labels[f"h{i:02d}"] for i in range(24)}) == 1
    assert labels["x"] == labels["z"] == labels["w"] != labels["h00"]


def test_clusters_come_from_the_power_iteration(spark):
    """Without steps k-means meets random vectors and joins nothing; with them a linked pair that is alone is joined, and of a chain a good part."""
    _, affinity = clusters.coarsened(chain(spark, 24))
    names = [f"x{i}" for i in range(clusters.VECTORS)]
    raw = affinity.select("a").distinct().select("a", *clusters._start("a", 0, names))
    assert clusters.k_means(affinity, raw).where("a <> label").count() == 0
    done = {bytes(r.a): bytes(r.label) for r in clusters.k_means(affinity, clusters.power_iteration(affinity)).collect()}
    assert done[b"y"] == done[b"yy"] and len(set(done.values())) < 0.75 * len(done)
    with pytest.raises(ValueError):
        clusters.merged(affinity, steps=0)


def test_current_documents(spark):
    rows = [(1, [1.0], "2026-01-01"), (1, [2.0], "2026-01-02"), (2, None, "2026-01-05"), (2, [1.0], "2026-01-01"), (3, [5.0], None), (3, [6.0], "2026-01-01"), (4, [7.0], None), (None, [1.0], None), (1, [2.0], "2026-01-02")]
    docs = spark.createDataFrame(rows, "doc_id long, embedding array<float>, w string").withColumn("written_utc", F.to_timestamp("w")).withColumn("id", F.lit("clash")).withColumn("raw", F.lit(0))
    got = {(r.id, tuple(r.raw or ())) for r in current_documents(docs).collect()}
    assert got == {("1", (2.0,)), ("2", ()), ("3", (6.0,)), ("4", (7.0,))}


DOCS = "doc_id long, text string, source string, key string, n int, toks string, tokens int, ids string"


def docs(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, s, "k", 1, "x", 2, "y") for i, t, s in rows], DOCS)


WORDS = [f"word{i}" for i in range(400)]


def test_neardup_edges(spark):
    assert neardup.similar(docs(spark, []))[0].count() == 0
    base = WORDS[:120]
    edited = [*base[:60], "other", *base[60:]]
    rows = [(1, " ".join(base), None), (2, " ".join(edited), None), (3, " ".join(base).upper(), None), (4, None, None), (5, "", None), (6, " \n\t", None), (7, "too short", None), (8, " ".join(WORDS[200:330]), None), (None, " ".join(base), None), (9, "x" * 50_000, None), (10, "same word " * 20_000, None), (1, " ".join(base), None)]
    links, member = neardup.similar(docs(spark, rows), size=5, threshold=0.8)
    assert {(r.a, r.b) for r in links.collect()} == {(1, 2)}
    assert {(r.doc, r.rep) for r in member.collect()} == {(1, 1), (2, 2), (3, 1), (8, 8), (10, 10)}


def test_neardup_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        base = list(rng.choice(WORDS, 60))
        rows.append((i, " ".join(base), None))
        for j in range(3):
            new = list(base)
            for at in rng.integers(0, 60, int(rng.integers(0, 9))):
                new[at] = rng.choice(WORDS)
            rows.append((1_000 + 10 * i + j, "shared footer of every document in the set " * 2 + " ".join(new), None))
    links, member = neardup.similar(docs(spark, rows), size=3, threshold=0.5)
    got = {(r.a, r.b) for r in links.collect()}
    sets = {}
    for i, text, _ in rows:
        w = text.split()
        sets.setdefault(frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2)), i)
    items = list(sets.items())
    want = {(min(a, b), max(a, b)) for n, (s, a) in enumerate(items) for t, b in items[:n] if len(s & t) / len(s | t) >= 0.5}
    assert got == want and member.count() == len(rows)


def test_neardup_hot_group_of_copies(spark):
    rows = [(i, " ".join(WORDS[:50]), None) for i in range(300)] + [(1_000 + i, " ".join(WORDS[i : i + 50]), None) for i in range(100, 200, 25)]
    links, member = neardup.similar(docs(spark, rows))
    assert links.count() == 0 and member.where("rep = 0").count() == 300


def test_encode_edges(spark):
    texts = [None, "", " ", "  two  spaces ", "<|endoftext|>", "naïve 日本語 🙂 x", "don't I'll 'em", "a" * 5_000, "x\x00y", "~!@#$%^&*()_+" * 50, "zq" * 3_000]
    got = {r.doc_id: r.ids for r in encode.encoded(docs(spark, [(i, t, None) for i, t in enumerate(texts)]), "doc_id", "text").collect()}
    plain = encode.codec(f"{encode.TOKENIZERS}/{encode.BYTE_BPE}").encoding
    assert got[0] == [] and got[1] == [] and len(got) == len(texts)
    assert all(got[i] == plain.encode_ordinary(t) for i, t in enumerate(texts) if t)
    assert encode.encoded(docs(spark, []), "doc_id", "text").count() == 0


def test_cuts_change_nothing():
    c = encode.codec(f"{encode.TOKENIZERS}/{encode.BYTE_BPE}")
    rng = np.random.default_rng(5)
    chars = [*map(chr, range(32, 127)), "\n", "\t", " ", "é", "日", "'s", "'ll", "  "]
    texts = ["".join(rng.choice(chars, int(rng.integers(0, 900)))) for _ in range(300)]
    assert c.encode(texts) == [c.encoding.encode_ordinary(t) for t in texts]
    assert sum(len(c.cuts(t.encode())) for t in texts) > 300
    assert c.encoding.decode(c.encode(texts)[0]) == texts[0]


def test_sainte_lague():
    assert mixing.sainte_lague([0.5, 0.3, 0.2], 10, [99] * 3) == [5, 3, 2]
    assert mixing.sainte_lague([0.5, 0.5], 10, [2, 99]) == [2, 8]
    assert mixing.sainte_lague([0.5, 0.5], 10, [2, 3]) == [2, 3]
    assert mixing.sainte_lague([], 10, []) == []


TARGETS = "source string, weight double, max_repeats int, doc_id int"


def test_mixing_edges(spark):
    none = spark.createDataFrame([], TARGETS)
    assert mixing.plan(mixing.sized(docs(spark, []), none), none) == []
    targets = spark.createDataFrame([("Big", 0.5, 2, 1), ("small", 0.3, 2, 2), ("gone", 0.2, 5, 3), ("Big", 0.5, 2, 1), (None, 0.1, 1, 4), ("null weight", None, 1, 5)], TARGETS)
    rows = [(i, "some words to count here", " BIG ") for i in range(300)] + [(1_000 + i, "tiny", "small") for i in range(20)] + [(5_000, None, "big"), (5_001, "", "big"), (5_002, "text", None), (5_003, "text", "unwanted")]
    sizes = mixing.sized(docs(spark, rows), targets)
    shares = {s.source: s for s in mixing.plan(sizes, targets, blocks=64)}
    assert set(shares) == {"Big", "small", "gone"} and not shares["Big"].short and shares["small"].short and shares["gone"].short
    mix = mixing.mixed(sizes, list(shares.values())).collect()
    blocks = {}
    for r in mixing.in_blocks(sizes, list(shares.values())).collect():
        blocks[r.key, r.block] = blocks.get((r.key, r.block), 0) + r.tokens
    assert all(abs(n - shares["Big"].size) <= 5 for (k, b), n in blocks.items() if k == "big" and b < shares["Big"].blocks - 1)
    assert mix and all(1 <= r.copies <= 2 for r in mix) and {r.source for r in mix} == {"Big", "small"}


def tongues(spark):
    english = "the cat sat on the mat and we saw it run to the red door while you were reading about the old house. " * 3
    german = "der Hund und die Katze sind in dem Haus mit der Maus und sie schlafen nicht auf dem Tisch. " * 3
    english += "An idiosyncratic transformation of the parameter undermines heterogeneous convergence and the epistemological terms. " * 3
    rows = [(100 + i, english if i % 2 else german, "en-US" if i % 2 else " DE") for i in range(12)]
    rows += [(200, german, "en"), (201, english, "und"), (202, None, "en"), (203, "", "en"), (None, english, "en")]  # a wrong label, and rows that say nothing
    return reading.train_tongues(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_reading_levels(spark):
    plain = "the cat sat on the mat and we saw it run to the red door. " * 6
    hard = "the epistemological heterogeneity of an idiosyncratic parameterisation undermines the convergence of the transformation. " * 6
    labels = spark.createDataFrame([(1, "plain"), (1, "plain"), (2, "expert"), (3, "plain"), (3, "expert"), (None, "plain"), (4, None)], "doc_id long, band string")
    rows = [(1, plain, "a"), (2, hard, "a"), (3, plain, "a"), (4, hard, "a"), (5, None, "a"), (6, "", "a"), (7, "short text", "a"), (8, "der Hund und die Katze sind in dem Haus mit der Maus und sie schlafen nicht " * 9, "a"), (9, plain * 800, "a")]
    table = docs(spark, rows)
    model = tongues(spark)
    got = {r.doc_id: r.band for r in reading.levelled(table, reading.train(table, labels), model).collect()}
    assert got == {1: "plain", 2: "expert", 3: "plain", 4: "expert", 9: "plain"}
    empty = reading.train(table, labels.where("false"))
    assert reading.levelled(table, empty, model).count() == 0 and reading.levelled(docs(spark, []), reading.train(table, labels), model).count() == 0
    assert reading.levelled(table, reading.train(table, labels), None).count() == 0


def test_posterior_has_priors_and_unseen_words():
    model = reading.Levels(("a", "b"), {"x": (math.log(0.2), math.log(0.1))}, (math.log(0.1), math.log(0.9)), (math.log(0.01), math.log(0.02)))
    p = model.posterior([["x", "x", "new"]])
    want = np.array([0.1 * 0.2 * 0.2 * 0.01, 0.9 * 0.1 * 0.1 * 0.02])
    assert np.allclose(p, want / want.sum()) and math.isclose(model.posterior([["x"] * 3, ["new"] * 3]).sum(), 1.0)


def test_languages_by_trigrams(spark):
    """A wrong label does not matter; a language that no label names is not taken for English."""
    model = tongues(spark)
    assert model.names == ("en", "de")
    english = lambda text: model.is_english(reading._pieces(text))
    assert english("We saw the old cat on the red mat. It ran to the door of the house.")
    assert not english("Die Maus und der Hund schlafen in dem Haus auf dem Tisch.")
    assert not english("Ktoś wziął żółtą książkę źle, gdyż świerszcz ćwierkał.") and not english("123 !?")
    assert reading.train_tongues(spark.createDataFrame([], "doc_id long, text string, lang string")) is None


def dense_rows(n):
    rng = np.random.default_rng(8)
    centre = axis(0) + 0.02 * rng.standard_normal((n, DIM))
    apart = rng.standard_normal((n, DIM))
    return [(f"d{i:04d}", blob(v)) for i, v in enumerate(np.concatenate([centre, apart]))]


def test_dense_cluster_over_several_leaves(spark):
    """A third and more of all rows in one tight cluster; the tree cuts it, every row still finds its neighbours."""
    rows = dense_rows(400)
    source = vectors(spark, rows)
    x = np.stack([np.frombuffer(b, "<f4") for _, b in rows]).astype("f8")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = set()
    for i in range(len(x)):
        s = x @ x[i]
        s[i] = -2
        for j in np.argsort(-s)[:5]:
            if s[j] >= 0.86:
                want.add((min(rows[i][0], rows[j][0]), max(rows[i][0], rows[j][0])))
    got = {(r.id_a, r.id_b) for r in neighbors.similar_pairs(source, leaf_rows=30).collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.1 * len(want)
    sizes = [r["size"] for r in clusters.of_size(clusters.clusters(source, leaf_rows=30)).collect()]
    assert sizes == [400]


def test_full_leaves_are_dealt_out_in_blocks(spark, monkeypatch):
    """Leaves of a tree that may not grow hold several blocks; the result is the same."""
    from vektrail.llm import vectors as module

    source = vectors(spark, dense_rows(200))
    whole = {tuple(r) for r in neighbors.similar_pairs(source).collect()}
    groups = {tuple(r) for r in clusters.of_size(clusters.clusters(source)).select("cluster_id", "size").collect()}
    monkeypatch.setattr(module, "MOST_LEAVES", 2)
    tree = module.fit_tree(source, module.MISS, leaf_rows=40)
    assert tree.leaves == 2 and tree.blocks.max() > 1
    dealt = {tuple(r) for r in neighbors.similar_pairs(source, leaf_rows=40).collect()}
    assert len(whole & dealt) >= 0.98 * len(whole | dealt)
    assert {tuple(r) for r in clusters.of_size(clusters.clusters(source, leaf_rows=40)).select("cluster_id", "size").collect()} == groups


def test_slots_deal_blocks_evenly(spark):
    from vektrail.llm import vectors as module

    y = np.random.default_rng(6).standard_normal((400, module.DIRECTIONS)).astype("f4")
    tree = module.Tree.fit(y, 16, 0.1, np.array([1, 3, 2] * 5 + [1]))
    slots, start = tree.slots()
    assert len(set(slots.tolist())) == tree.blocks.sum() == tree.tasks and start[1] == 1 and start[2] == 4
    got = spark.createDataFrame([(int(x),) for x in slots], "slot int").repartition(tree.tasks, "slot").select(F.spark_partition_id().alias("p")).distinct().count()
    assert got == tree.tasks


def test_descent_equals_the_boxes_of_all_leaves():
    """The pruned descent finds the leaves that a scan of all leaf boxes finds, and every row's own leaf holds it."""
    from vektrail.llm import vectors as module

    rng = np.random.default_rng(4)
    y = rng.standard_normal((501, module.DIRECTIONS)).astype("f4")  # an odd number: the cuts are values of rows
    tree = module.Tree.fit(y, 32, 0.05)
    low, high = np.full((63, module.DIRECTIONS), -np.inf), np.full((63, module.DIRECTIONS), np.inf)
    for node in range(31):
        for child in (2 * node + 1, 2 * node + 2):
            low[child], high[child] = low[node], high[node]
        high[2 * node + 1, tree.axis[node]] = low[2 * node + 2, tree.axis[node]] = tree.cut[node]
    low, high = low[31:], high[31:]
    own = tree.home(y)
    assert ((y >= low[own]) & (y < high[own])).all()
    row, leaf, far = tree.visits(y, np.full(501, 0.28))
    seen = dict(zip(zip(row.tolist(), leaf.tolist(), strict=True), far, strict=True))
    out = np.maximum(np.maximum(low[None] - y[:, None], y[:, None] - high[None]), 0)
    d2 = (out * out).sum(2)
    for (r, k), d in seen.items():
        assert k != own[r] and math.isclose(d, d2[r, k], rel_tol=1e-4)
    near = {(int(r), int(k)) for r, k in zip(*np.nonzero((d2 <= tree.limit[1:].min() * 0.28) & (np.arange(32) != own[:, None])), strict=True)}
    assert near <= set(seen)


def test_chi_square_tail():
    assert math.isclose(module_tail(1, 3.841458820694124), 0.05, rel_tol=1e-9) and math.isclose(module_tail(6, 12.591587243743977), 0.05, rel_tol=1e-9) and math.isclose(module_tail(7, 14.067140449340169), 0.05, rel_tol=1e-9)


def module_tail(j, t):
    from vektrail.llm.vectors import chi2_tail

    return chi2_tail(j, t)
