"""The table of this package's registered queries."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from citemill.registry.catalog import Query, Registered

QUERIES: dict[str, Registered] = {}
MODULES = (
    "rule_ledger",
    "line_index",
    "markov_secrets",
    "host_paths",
    "language_mixture",
    "extendible_dedup",
    "piece_agenda",
    "simhash_balls",
    "concat_cut",
    "hilbert_shards",
    "word_runs",
    "hard_negatives",
    "warc_chunks",
)


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its DuckDB twin where SQL can say it."""

    def add(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = Registered(run, sql)
        return run

    return add


def load_all() -> dict[str, Registered]:
    for module in MODULES:
        importlib.import_module(f"citemill.llm.{module}")
    return QUERIES
