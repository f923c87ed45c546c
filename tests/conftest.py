import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from citemill import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", os.environ.get("TEST_MASTER", "local[8]"))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def apply(spark):
    """Value of a one-column expression for each text."""

    def run(expression, texts):
        from pyspark.sql import functions as F

        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        found = rows.select("i", expression(F.col("t")).alias("v")).orderBy("i").collect()
        return [row.v for row in found]

    return run
