"""Catalogue of registered queries: name → (Spark plan builder, oracle SQL).

Each builder takes ``(spark, data_dir)`` and returns a DataFrame over the
whole tables of that folder; the SQL text computes the same rows in an ANSI
engine over the same parquet files (``None`` when not SQL-expressible).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Entry:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        if name in REGISTRY:
            raise KeyError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, sql)
        return fn
    return deco


MODULES = ("q_clean", "q_splits", "q_candidates", "q_metrics", "q_neighbors", "q_diversity",
           "q_factors", "q_encode", "q_sequences", "q_text", "q_sources", "q_news")


def load_all() -> dict[str, Entry]:
    """Import the catalogue modules (importing fills ``REGISTRY``)."""
    import importlib
    import importlib.util

    for m in MODULES:
        full = f"recoflow.registry.{m}"
        if importlib.util.find_spec(full) is not None:
            importlib.import_module(full)
    return REGISTRY
