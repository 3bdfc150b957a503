"""Exact intervals of jobs with few and with very many items."""

from __future__ import annotations

import math
import signal

import numpy as np
import pytest

from vektrail.operators import stats


def added_up(k: int, n: int, p: float) -> float:
    """P(X >= k), outcome by outcome; long doubles, as the running sum of a million logarithms in doubles is good for six digits only."""
    facts = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1, dtype=np.longdouble)))])
    i = np.arange(k, n + 1)
    return float(np.exp(facts[n] - facts[i] - facts[n - i] + i * math.log(p) + (n - i) * math.log1p(-p)).sum())


def test_interval_of_a_million_items_is_exact_and_ends_soon():
    def late(*_):
        raise AssertionError("one interval took more than 20 seconds")

    before = signal.signal(signal.SIGALRM, late)
    signal.alarm(20)
    try:
        low, high = stats.clopper_pearson(170_000, 1_000_000)
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, before)
    assert added_up(170_000, 1_000_000, low) == pytest.approx(0.025, rel=1e-6)
    assert 1 - added_up(170_001, 1_000_000, high) == pytest.approx(0.025, rel=1e-6)


def test_tails_equal_the_sum_of_outcomes():
    for n in (1, 2, 7, 40, 333):
        for k in {0, 1, n // 6, n // 2, n - 1, n}:
            for p in (1e-9, 0.01, 0.17, 0.5, 0.83, 0.999):
                want = math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
                assert stats.binomial_tail(k, n, p) == pytest.approx(want, rel=1e-10, abs=1e-14)
