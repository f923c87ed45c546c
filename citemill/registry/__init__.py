"""Queries over the given tables, each with the SQL that must give the same rows."""

from citemill.registry.catalog import QUERIES, load_all

__all__ = ["QUERIES", "load_all"]
