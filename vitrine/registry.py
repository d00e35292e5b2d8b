"""Query registry: name -> (Spark builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with an optional oracle SQL text."""

    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


PLAN_MODULES = [
    "vitrine.plans.preprocess_queries", "vitrine.plans.quality", "vitrine.plans.bi", "vitrine.plans.landing_queries",
    "vitrine.plans.enrichment", "vitrine.plans.features", "vitrine.plans.rules", "vitrine.plans.clustering",
    "vitrine.plans.ml", "vitrine.plans.evaluation", "vitrine.plans.routing", "vitrine.plans.io_queries", "vitrine.streaming.jobs",
]


def load_all() -> None:
    """Import every plan module so that its queries register."""
    import importlib

    for mod in PLAN_MODULES:
        importlib.import_module(mod)
