"""Every registered query against its SQL on the smallest data set."""

import pytest
from oracle_check import compare, connect

import __spark_entry__
from citemill.registry import load_all

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(load_all()))
def test_rows_equal_sql(spark, connection, name):
    assert compare(spark, connection, FOLDER, name) == ""


def test_entry_gives_citations(spark):
    result = __spark_entry__.entry(spark)
    assert result.columns == ["query_id", "rank", "document", "page", "section", "snippet", "distance"]
    assert result.count() > 0


def test_contract():
    core = load_all()
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(core) <= set(queries) and set(sql) < set(queries)
    assert {name for name in core if name not in sql} == {
        "t1_split_chunks", "t2_embed", "j4_knn_join_approx"
    }
