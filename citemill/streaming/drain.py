"""Running a stream over what there is: parts of a table as they would arrive, and the rows that come out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citemill.session import delete_on_exit, scratch_path

PARTS = 3
FILES = 4


def arrive_in_parts(rows: DataFrame, last: DataFrame, path: str, columns: list[str], parts: int = PARTS) -> DataFrame:
    """A stream of the ``rows`` in equal spans of their time ``arrived``, a micro-batch each, and ``last`` after them."""
    spark = rows.sparkSession
    kept = scratch_path(spark, "arriving")
    rows.write.parquet(kept)
    rows = spark.read.schema(rows.schema).parquet(delete_on_exit(spark, kept))
    at = F.unix_micros(F.col("arrived").cast("timestamp"))
    first, end = rows.agg(F.min(at), F.max(at)).first()
    span = 1 if first is None else (end - first) // parts + 1
    part = F.floor((at - F.lit(first or 0)) / F.lit(span))
    for number in range(parts):
        rows.where(part == number).select(*columns).repartition(FILES).write.mode("append").parquet(path)
    last.select(*columns).coalesce(1).write.mode("append").parquet(path)
    delete_on_exit(spark, path)
    schema = rows.select(*columns).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES).parquet(path)


def drained(stream: DataFrame) -> DataFrame:
    """All that the stream gives for the files that are there now."""
    spark = stream.sparkSession
    out = scratch_path(spark, "drained")
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", scratch_path(spark, "progress"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(delete_on_exit(spark, out))
