"""Collects the registered queries."""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register `fn(spark, sf_dir)`; `sql` is what an independent engine runs on the same tables."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


for _part in ("windows", "intervals", "texts", "results", "training", "regions", "feeds", "live"):
    importlib.import_module(f"crowdpeak.checks.{_part}")
