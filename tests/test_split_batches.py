"""The splitter's worker holds few rows as Python objects, whatever the batch."""

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from citemill.functions import fixed_values as fixed
from citemill.operators.chunking import split_batches, split_chunks, split_text


def test_memory_does_not_go_by_the_batch():
    batch = pa.array([f"{i} " + "word " * 600 for i in range(5000)])
    tracemalloc.start()
    rows = sum(len(part) for part in split_batches(iter([batch]), fixed.CHUNK_SIZE, fixed.CHUNK_OVERLAP))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # The texts alone have 15 MB, their chunks more.
    assert rows == 5000 and peak < 8 << 20


def test_rows_keep_their_chunks_over_slices(spark):
    texts = [None if i % 50 == 7 else "" if i % 50 == 8 else f"{i} " + "word. " * (i % 400) for i in range(1500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    found = rows.select("i", "t", split_chunks(F.col("t")).alias("chunks")).collect()
    assert len(found) == 1500
    assert all(r.t == texts[r.i] and r.chunks == (split_text(r.t) if r.t else []) for r in found)
