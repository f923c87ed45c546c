"""Exact dedup over an extendible-hash index kept on shared files.

Texts are equal when identical after A-Z are lower-cased. A text's key is a 64-bit
hash. The directory maps the first ``depth`` bits of a key to a bucket; a bucket
with more distinct keys than it may hold splits in two by its next bit, and where a
bucket already uses all bits of the directory, the directory doubles first.
An entry of the index is one distinct text: keys that collide form a chain of
entries, told apart by their bytes. Each bucket is a key range of one owner task.

Only column functions on the data. The driver sees the loads of at most 65,536
directory slots, never keys or texts. A group of copies is one partial row per
task before anything is shuffled, so its size does not matter.

Null text counts as empty. Of equal texts the row with the largest doc_id stays; a
null doc_id is below all others. Rows that repeat a doc_id are rows of their own and
count in ``group_size``; all rows with the winning doc_id are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from citemill.llm.catalog import register
from citemill.llm.common import ascii_lower, delete_on_exit, staged, table, texts
from citemill.session import scratch_path

BUCKET_KEYS = 50_000
DEPTH_MAX = 16


def key_prefix(key: Column, depth: int) -> Column:
    """The first ``depth`` bits of a key as a number."""
    return F.shiftrightunsigned(key, 64 - depth).cast("int") if depth else F.lit(0)


def build_directory(loads: dict[int, int], capacity: int, finest: int) -> list[int]:
    """Bucket numbers of the directory's slots, after all splits.

    ``loads`` counts keys by their first ``finest`` bits. A bucket is a pair (depth,
    prefix); the directory is as deep as its deepest bucket.
    """
    counts = {(finest, slot): n for slot, n in loads.items()}
    for depth in range(finest, 0, -1):
        for slot in {s for d, s in counts if d == depth}:
            half = counts[depth, slot]
            counts[depth - 1, slot >> 1] = counts.get((depth - 1, slot >> 1), 0) + half
    depth, buckets, pending = 0, [], [(0, 0)]
    while pending:
        local, prefix = pending.pop()
        if counts.get((local, prefix), 0) > capacity and local < finest:
            depth = max(depth, local + 1)  # doubling, where this bucket was as deep as the directory
            pending += [(local + 1, 2 * prefix + 1), (local + 1, 2 * prefix)]
        else:
            buckets.append((local, prefix))
    slots = [0] * (1 << depth)
    for number, (local, prefix) in enumerate(buckets):
        first = prefix << (depth - local)
        slots[first : first + (1 << (depth - local))] = [number] * (1 << (depth - local))
    return slots


def directory_of(keys: DataFrame, capacity: int | None = None) -> list[int]:
    """The directory for these keys.

    Without a capacity a bucket holds 50,000 keys, or more once 65,536 slots would
    not do; a bucket is then an even share of all keys.
    """
    distinct = keys.groupBy("key").agg(F.lit(1).alias("one"))
    slot = key_prefix(F.col("key"), DEPTH_MAX).alias("slot")
    loads = {r.slot: r.n for r in distinct.groupBy(slot).agg(F.count("*").alias("n")).collect()}
    limit = capacity or max(BUCKET_KEYS, 4 * sum(loads.values()) >> DEPTH_MAX)
    return build_directory(loads, limit, DEPTH_MAX)


def bucket_of(key: Column, directory: list[int]) -> Column:
    """The bucket that a key's directory slot points to."""
    depth = len(directory).bit_length() - 1
    slots = F.split(F.lit(",".join(map(str, directory))), ",").cast("array<int>")
    return F.get(slots, key_prefix(key, depth))


def normalised(docs: DataFrame, place: str | None = None) -> DataFrame:
    """``row`` is what rows of a group are compared by: the doc_id and, where given, the place."""
    row = F.struct("doc_id", *([F.col(place).alias("place")] if place else [])).alias("row")
    return docs.select(row, ascii_lower(texts(F.col("text"))).alias("body")).withColumn(
        "key", F.xxhash64("body")
    )


def build_index(docs: DataFrame, directory: list[int], place: str | None = None) -> DataFrame:
    """One row per distinct text: bucket, key, chain, sha, keep (the greatest row), group_size.

    Grouping is by bucket, key and the bytes of the text, with a partial row per
    task first; ``chain`` numbers the different texts of one key. The index is
    written one folder per bucket by the bucket's owner task.
    """
    entries = (
        normalised(docs, place)
        .withColumn("bucket", bucket_of(F.col("key"), directory))
        .groupBy("bucket", "key", "body")
        .agg(F.max("row").alias("keep"), F.count("*").alias("group_size"))
        .select("bucket", "key", F.sha2("body", 256).alias("sha"), "keep", "group_size")
    )
    chain = F.row_number().over(Window.partitionBy("bucket", "key").orderBy("sha"))
    owned = entries.repartition("bucket").withColumn("chain", chain)
    spark = docs.sparkSession
    path = scratch_path(spark, "extendible-index")
    owned.write.partitionBy("bucket").parquet(path)
    delete_on_exit(spark, path)
    return spark.read.schema(owned.schema).parquet(path)


def look_up(keys: DataFrame, index: DataFrame, directory: list[int]) -> DataFrame:
    """Rows with their entries: a key's directory slot names the bucket, and there its chain is searched for the text."""
    placed = keys.withColumn("bucket", bucket_of(F.col("key"), directory))
    return placed.join(index.hint("merge"), ["bucket", "key", "sha"])


def exact_groups(docs: DataFrame, capacity: int | None = None, place: str | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain.

    ``place`` names a column that tells all rows apart. It comes along, and of the rows
    that share text and doc_id only the one with the greatest place is kept then.
    """
    keys = staged(
        normalised(docs, place).select("row", "key", F.sha2("body", 256).alias("sha")), "dedup-keys"
    )
    directory = directory_of(keys, capacity)
    found = look_up(keys, build_index(docs, directory, place), directory)
    return found.select(
        "row.doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        F.col("row").eqNullSafe(F.col("keep")).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "bucket",
        "chain",
        *([F.col("row.place").alias(place)] if place else []),
    )


SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM d JOIN g USING (body)
"""


@register("op6_extendible_dedup", SQL)
def op6_extendible_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_groups(table(spark, folder, "documents")).drop("bucket", "chain")
