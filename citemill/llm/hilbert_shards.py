"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised to a few bits each and mapped to a place
on a Hilbert curve, on which rows that are close lie close in every dimension. Rows
are sorted by place and doc_id and cut into runs of equal counts (at most one
apart), so a shard covers a small range of every dimension and readers can prune
shards by any of them.

Dimensions are columns or expressions; numbers are cut at given bounds, names are
hashed to a bounded number of codes. A null has code 0. The sort is a range
partitioning on place and doc_id, so one value that holds a third of all rows is
still spread. A row's rank is its place in its partition plus the partitions before
it, of which only the counts reach the driver.

Rows that repeat a doc_id are separate rows and may end in different slots; an empty
table gives no shards. Other columns pass through whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citemill.llm.catalog import register
from citemill.llm.common import staged, table

SHARDS = 40
BITS = 5
ROW_BYTES = 16


def hilbert_index(coordinates: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with ``bits`` bits in each dimension (a column each).

    Gray-code form: undo the excess rotations from the highest bit down, then Gray
    encode, then interleave the bits.
    """
    x = [coordinates[:, d].astype(np.int64) for d in range(coordinates.shape[1])]
    level = 1 << (bits - 1)
    while level > 1:
        below = level - 1
        for d in range(len(x)):
            inside = (x[d] & level) != 0
            swap = np.where(inside, 0, (x[0] ^ x[d]) & below)
            x[0] = np.where(inside, x[0] ^ below, x[0] ^ swap)
            if d:
                x[d] = x[d] ^ swap
        level >>= 1
    for d in range(1, len(x)):
        x[d] = x[d] ^ x[d - 1]
    flip = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        flip = np.where((x[-1] & level) != 0, flip ^ (level - 1), flip)
        level >>= 1
    place = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for value in x:
            place = (place << 1) | (((value ^ flip) >> bit) & 1)
    return place


def by_name(column: Column, bits: int = BITS) -> Column:
    """Code of a name: 0 for null, else 1 to 2**bits - 1 by hash."""
    return F.coalesce(F.pmod(F.xxhash64(column), F.lit((1 << bits) - 1)) + 1, F.lit(0)).cast("int")


def by_bounds(column: Column, bounds: list[float], bits: int = BITS) -> Column:
    """Code of a number: 0 for null, else one more than the bounds at or below it."""
    if len(bounds) > (1 << bits) - 2:
        raise ValueError("more bounds than codes")
    code = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= column)) + 1
    return F.when(column.isNull(), F.lit(0)).otherwise(code).cast("int")


def curve_place(codes: list[Column], bits: int = BITS) -> Column:
    """Place on the curve of the point that the codes name."""

    @F.pandas_udf("long")
    def place(*columns: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in columns], axis=1), bits))

    return place(*codes)


def shard_runs(
    rows: DataFrame, codes: list[Column], shards: int = SHARDS, bits: int = BITS
) -> DataFrame:
    """Every row as a struct ``row``, with its place, rank, shard and slot.

    The sorted table is written once; its partitions lie along the curve, so writing
    the shards from it needs no further shuffle.
    """
    placed = rows.select(F.struct("*").alias("row"), curve_place(codes, bits).alias("place"))
    ordered = placed.repartitionByRange("place", F.col("row.doc_id")).sortWithinPartitions(
        "place", "row.doc_id"
    )
    # The partition's number in the upper bits, the row's place in it in the lower 33.
    numbered = staged(ordered.withColumn("at", F.monotonically_increasing_id()), "curve-order")
    part = F.shiftright("at", 33)
    sizes = {r.part: r.n for r in numbered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    before, total = [0] * (max(sizes, default=0) + 1), 0
    for number in sorted(sizes):
        before[number], total = total, total + sizes[number]
    bases = F.split(F.lit(",".join(map(str, before))), ",").cast("array<long>")
    rank = F.get(bases, part.cast("int")) + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    each, longer = divmod(total, shards)
    # The first ``longer`` shards hold one row more.
    border = longer * (each + 1)
    shard = F.when(F.col("rank") < border, F.floor(F.col("rank") / (each + 1))).otherwise(
        longer + F.floor((F.col("rank") - border) / max(1, each))
    )
    slot = F.when(F.col("rank") < border, F.col("rank") % (each + 1)).otherwise(
        (F.col("rank") - border) % max(1, each)
    )
    return numbered.withColumn("rank", rank).select(
        "row", "place", "rank", shard.cast("int").alias("shard"), slot.cast("long").alias("slot")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in curve order; each task writes the few shards it crosses."""
    sharded.select("row.*", F.col("shard").alias("curve_shard")).write.partitionBy("curve_shard").parquet(path)


SIZE_BOUNDS = [float(1 << k) for k in range(5, 30)]


def document_codes(lang: str, source: str, size: str) -> list[Column]:
    """The dimensions documents are pruned by: language, source, size on a log scale."""
    return [by_name(F.col(lang)), by_name(F.col(source)), by_bounds(F.col(size), SIZE_BOUNDS)]


@register("op10_hilbert_shards")
def op10_hilbert_shards(spark: SparkSession, folder: str) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit(""))
    slim = table(spark, folder, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "lang",
        "source",
        (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    return shard_runs(slim, document_codes("lang", "source", "size")).select(
        "row.doc_id",
        "row.size",
        "row.text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
