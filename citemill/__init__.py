"""Spark jobs that build and query a citable document knowledge base.

Layout
------
``functions``  column expressions: text clean-up, sections, hashing, answers
``sources``    file listings, the versioned chunk store, event lines
``operators``  scans, splitting, nearest neighbours, retrieval, cache replay
``plans``      whole jobs put together from the operators
``streaming``  Structured Streaming forms of the stateful jobs
``registry``   the queries run by the correctness check, with their SQL twins
"""

from citemill.session import build_session, prepare_session

__all__ = ["build_session", "prepare_session"]
