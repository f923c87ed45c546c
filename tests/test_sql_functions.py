import pytest

from citemill.functions.sql import register_sql_functions
from citemill.operators.chunking import split_text


def test_split_chunks_in_sql(spark):
    register_sql_functions(spark)
    texts = ["First part. Second part; third\n\nfourth " * 60, "short", "", None, "x" * 2500]
    spark.createDataFrame(list(enumerate(texts)), "id int, text string").createOrReplaceTempView("sql_texts")
    rows = spark.sql("SELECT t.id, c.* FROM sql_texts t, LATERAL split_chunks(t.text) c").collect()
    expected = [(i, k, chunk) for i, text in enumerate(texts) for k, chunk in enumerate(split_text(text) if text else [])]
    assert sorted(map(tuple, rows)) == expected
    rows = spark.sql("SELECT t.id, c.* FROM sql_texts t, LATERAL split_chunks(t.text, 100, 20) c").collect()
    expected = [(i, k, chunk) for i, text in enumerate(texts) for k, chunk in enumerate(split_text(text, 100, 20) if text else [])]
    assert sorted(map(tuple, rows)) == expected
    with pytest.raises(Exception, match="overlap"):
        spark.sql("SELECT * FROM split_chunks('a', 10, 10)").collect()
