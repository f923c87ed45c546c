"""Registered queries with a SQL twin."""

import pytest
from oracle_check import connect, rows_of

import __spark_entry__
from citemill.llm import load_all

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(n for n, r in load_all().items() if r.sql))
def test_rows_equal_sql(spark, name):
    frame, relation = load_all()[name].run(spark, FOLDER), connect(FOLDER).sql(load_all()[name].sql)
    assert sorted(frame.columns) == sorted(relation.columns)
    assert rows_of(frame.columns, frame.collect()) == rows_of(relation.columns, relation.fetchall())


def test_all_are_registered():
    names = set(__spark_entry__.queries())
    assert set(load_all()) | {"pipeline"} <= names
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
