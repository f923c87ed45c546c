"""Embedding and cosine distance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citemill.functions import fixed_values as fixed
from citemill.functions.text import embedding_text

Embedder = Callable[[DataFrame, str, str], DataFrame]


def hashed_word_embedder(
    rows: DataFrame, text: str, out: str, size: int = fixed.EMBEDDING_SIZE
) -> DataFrame:
    """Unit vectors of hashed word counts, words of any script: needs no model and no fitting.

    A text without words has the zero vector, at distance 1 from everything.
    """
    steps = Pipeline(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="__words", pattern=r"(?U)\W+", toLowercase=True),
            HashingTF(inputCol="__words", outputCol="__counts", numFeatures=size),
            Normalizer(inputCol="__counts", outputCol="__unit"),
        ]
    )
    # None of these stages learns from data, so fit() reads no rows.
    vectors = steps.fit(rows).transform(rows)
    return vectors.withColumn(out, vector_to_array("__unit", "float32")).drop("__words", "__counts", "__unit")


def table_embedder(vectors: DataFrame, key: str, vector: str = "embedding") -> Embedder:
    """An embedder that looks vectors up in a table by the rows' ``key`` column.

    Rows without a vector keep a null one; ``missing_vectors`` reports them. Of several
    vectors for one key the greatest counts, so no row is doubled. No broadcast: the
    table grows with the rows.
    """
    supplied = vectors.groupBy(F.col(key).alias("__key")).agg(F.max(vector).alias("__vector"))

    def look_up(rows: DataFrame, text: str, out: str) -> DataFrame:
        found = rows.join(supplied, F.col(key) == F.col("__key"), "left")
        return found.withColumn(out, F.col("__vector")).drop("__key", "__vector")

    return look_up


def missing_vectors(embedded: DataFrame, by: list[str], out: str = "embedding") -> DataFrame:
    """Rows and rows without a vector, per group: what a supplied table does not cover."""
    return embedded.groupBy(*by).agg(F.count("*").alias("n_rows"), F.count_if(F.col(out).isNull()).alias("n_missing"))


def embed(
    rows: DataFrame, text: str = "text", out: str = "embedding", embedder: Embedder = hashed_word_embedder
) -> DataFrame:
    """Add a vector per row. ``embedder(rows, text_column, out_column)`` is pluggable."""
    prepared = rows.withColumn("__embed_text", embedding_text(F.coalesce(text, F.lit(""))))
    return embedder(prepared, "__embed_text", out).drop("__embed_text")


def _sum_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, value: total + value)


def _dot(a: Column, b: Column) -> Column:
    return _sum_of(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 minus the cosine of two arrays in one row, worked out in double; 1 where one is zero."""
    cosine = F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))
    return F.when(a.isNotNull() & b.isNotNull(), 1 - F.coalesce(cosine, F.lit(0.0)))
