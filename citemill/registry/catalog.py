"""The table of registered queries."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Registered:
    run: Query
    sql: str | None


QUERIES: dict[str, Registered] = {}
MODULES = ("file_queries", "text_queries", "chunk_queries", "retrieval_queries", "answer_queries", "cache_queries")


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its operator's name; ``sql`` is its DuckDB twin."""

    def add(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = Registered(run, sql)
        return run

    return add


def load_all() -> dict[str, Registered]:
    for module in MODULES:
        importlib.import_module(f"citemill.registry.{module}")
    return QUERIES
