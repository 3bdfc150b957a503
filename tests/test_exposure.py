"""Blind alignment: its stages, the split and the seeds."""

import numpy as np
import pytest

from vektrail.operators import exposure
from vektrail.plans.fixtures import new, old


def clouds(rng, n, dim=8):
    """Two disjoint samples of uneven clusters, the second one rotated."""
    centres, w = rng.standard_normal((12, dim)), np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    draw = lambda m: exposure.unit(centres[rng.integers(0, 12, m)] * 2 + 0.5 * rng.standard_normal((m, dim)))
    return draw(n), draw(n + 7) @ w, w


def side(spark, x, most=None):
    return exposure.Side(spark.createDataFrame([(i, [float(e) for e in v]) for i, v in enumerate(x)], "id long, v array<double>"), x.shape[1], most)


def test_swaps_recover_a_permutation():
    rng = np.random.default_rng(1)
    g = rng.standard_normal((20, 20))
    a, p = g @ g.T, rng.permutation(20)
    got, score = exposure.match(a[np.ix_(p, p)], a)
    assert (got == p).all() and score == pytest.approx(1.0)


def test_no_swap_improves_a_match():
    rng = np.random.default_rng(2)
    a, b = (x + x.T for x in rng.standard_normal((2, 9, 9)))
    p, _ = exposure.match(a, b, restarts=1)
    value = (a * b[np.ix_(p, p)]).sum()
    for i in range(9):
        for j in range(i):
            q = p.copy()
            q[i], q[j] = q[j], q[i]
            assert (a * b[np.ix_(q, q)]).sum() <= value + 1e-9


def test_published_counts_are_the_defaults():
    e = exposure
    assert (e.SAMPLE, e.ROUNDS, e.CENTRES, e.RESTARTS, e.NEIGHBOURS, e.STEPS, e.CLUSTERS, e.BLEND, e.SEEDS) == (10_000, 30, 20, 30, 50, 100, 500, 0.5, (0, 1, 2))


def test_halves_are_disjoint_and_unequal(spark, sf):
    held, a, b = exposure.split(old(spark, sf), new(spark, sf))
    ids = [{r.id for r in x.select("id").collect()} for x in (a, b, old(spark, sf).where(held))]
    assert all(ids) and len(ids[0]) != len(ids[1]) and sum(map(len, ids)) == len(set().union(*ids)) == old(spark, sf).count()


def test_alignment_finds_a_rotation(spark):
    x, y, w = clouds(np.random.default_rng(3), 900)
    got = exposure.align(side(spark, x), side(spark, y), steps=30)
    assert ((exposure.unit(x @ got) * (x @ w)).sum(1)).mean() > 0.9


def test_targets_in_the_cluster_give_the_same_means(spark):
    x, y, _ = clouds(np.random.default_rng(4), 120)
    near, far = side(spark, y), side(spark, y, most=50)
    assert near.local is not None and far.local is None and len(far.sample(1)) == 50
    for relative in (None, exposure.unit(y[:30])):
        q = x if relative is None else exposure.unit(x @ relative.T)
        assert np.allclose(near.matched_mean(q, 5, relative), far.matched_mean(q, 5, relative))


def test_three_seeds_and_the_best(spark, sf, monkeypatch):
    monkeypatch.setattr(exposure.align, "__defaults__", (0, 2, 2))
    rows = exposure.measure(old(spark, sf), new(spark, sf)).orderBy("seed").collect()
    assert [r.seed for r in rows] == [0, 1, 2] and [r.best for r in rows].count(True) == 1
    assert max(r.identified for r in rows) == next(r for r in rows if r.best).identified and len({r.unstable for r in rows}) == 1
