"""Registered queries: each is a Spark plan over the supplied tables (or views
derived from them) plus, where an exact answer exists, the DuckDB SQL the
driver compares it with. Column names are aliased identically on both sides."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ops: str


REGISTRY: dict[str, Query] = {}


def register(name: str, ops: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, ops)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    """Import every query module (each registers on import)."""
    import importlib
    for mod in QUERY_MODULES:
        importlib.import_module(f"tessera.plans.{mod}")
    return REGISTRY


QUERY_MODULES = ["q_profile", "q_clean", "q_select", "q_outliers", "q_encode", "q_relevance", "q_vectors", "q_cluster", "q_explain"]
