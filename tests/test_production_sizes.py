"""Registered queries run with the operators' own counts."""

import pytest

import __spark_entry__ as entry
from vektrail.operators import adapters, metrics


class Reached(Exception):
    pass


def test_probe_draws_as_often_as_the_operator(spark, sf, monkeypatch):
    whole = metrics.bootstrap

    def seen(per_query, value, draws=metrics.DRAWS, **kw):
        raise Reached(draws)

    assert whole.__defaults__[0] == metrics.DRAWS == 2_000
    monkeypatch.setattr(metrics, "bootstrap", seen)
    with pytest.raises(Reached, match="^2000$"):
        entry.queries()["probe_shear"](spark, sf)


def test_network_has_the_operators_size(spark, sf, monkeypatch):
    def seen(pairs, m, hidden=256, epochs=60):
        raise Reached(hidden, epochs)

    assert adapters.residual_mlp.__defaults__[:2] == (256, 60)
    monkeypatch.setattr(adapters, "residual_mlp", seen)
    with pytest.raises(Reached, match="256, 60"):
        entry.queries()["fit_residual_mlp"](spark, sf)
