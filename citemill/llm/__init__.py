"""Operators of a large training-data pipeline.

Each module holds one operator with its own interface and the thin registered
query that derives the checked columns from it. Nothing else in the library
imports this package.
"""

from citemill.llm.catalog import QUERIES, load_all

__all__ = ["QUERIES", "load_all"]
