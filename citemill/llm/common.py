"""Helpers the operators share: inputs, staged tables, Arrow limits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citemill.session import prepare_session, scratch_path

ARROW_ROWS = 1000
ARROW_BYTES = 32 * 1024 * 1024
# Space, tab, newline, vertical tab, form feed, carriage return: what separates words.
BLANKS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table; texts reach Python in batches bounded by rows and by bytes."""
    prepare_session(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def with_place(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a column that tells its rows apart and is the same at every read.

    Rows of Parquet files go by file and position. Other frames are written first.
    """
    spark = docs.sparkSession
    if "_metadata" not in docs.columns:
        try:
            placed = docs.select("*", F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).alias(name))
            placed.schema  # raises where the frame is not a plain file scan
            return placed
        except AnalysisException:
            pass
    return staged(docs.withColumn(name, F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at"))), "placed-rows")


def slices(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts in ``column`` have about ``size`` bytes, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    runs = np.cumsum(lengths, dtype=np.int64) // size
    starts = [0, *(np.flatnonzero(np.diff(runs)) + 1), len(runs)]
    for start, end in zip(starts, starts[1:]):
        if end > start:
            yield batch.slice(start, end - start)


def staged(frame: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back, which cuts lineage.

    The files go when the application ends, since the lazy result still reads them.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, label)
    frame.write.parquet(path)
    delete_on_exit(spark, path)
    return spark.read.schema(frame.schema).parquet(path)


def delete_on_exit(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


def texts(column: Column) -> Column:
    """A text, null as empty."""
    return F.coalesce(column, F.lit(""))


def ascii_lower(column: Column) -> Column:
    """A-Z in lower case and no other letter.

    ``lower`` does the same where every character is one byte, and is much faster.
    """
    narrow = F.octet_length(column) == F.char_length(column)
    return F.when(narrow, F.lower(column)).otherwise(F.translate(column, UPPER, UPPER.lower()))
