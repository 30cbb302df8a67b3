"""All queries of the core, with their SQL."""
from __future__ import annotations

import importlib

MODULES = ("records", "letters", "matching", "extras")


def collect() -> tuple[dict, dict]:
    queries, oracle = {}, {}
    for name in MODULES:
        m = importlib.import_module(f"helixframe.plans.{name}")
        queries.update(m.QUERIES)
        oracle.update(m.ORACLE)
    return queries, oracle
