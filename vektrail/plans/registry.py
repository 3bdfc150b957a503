"""All core queries and their DuckDB twins."""

from __future__ import annotations

import importlib

_MODULES = ("feed", "vectors", "metrics", "sampling", "models", "serving", "state", "statistics", "probe", "housekeeping")


def collect() -> tuple[dict, dict]:
    queries: dict = {}
    oracles: dict = {}
    for name in _MODULES:
        try:
            module = importlib.import_module(f"vektrail.plans.{name}")
        except ModuleNotFoundError as error:
            if error.name != f"vektrail.plans.{name}":
                raise
            continue
        queries.update(module.QUERIES)
        oracles.update(module.ORACLES)
    return queries, oracles
