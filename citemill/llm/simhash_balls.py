"""SimHash near-dedup by multi-index hashing.

A fingerprint has 64 bits; bit b is set where more than half of the text's shingle
hashes have it. To find all fingerprints within 4 bits, the 64 bits are cut into
three segments that are each looked up in a table of that segment's values within a
small Hamming ball: radii 1, 1 and 0. Two fingerprints that differ by more than the
radius in every segment differ by at least 2 + 2 + 1 = 5 bits, so no link is lost.
Each match is verified on the complete distance.

Only different fingerprints are indexed; copies of a fingerprint stand behind one
row. Tables are dealt by segment value; a task compares what meets in a bucket in
blocks and sends on a spanning forest of the links, never all pairs. Buckets in
which more than ``BUCKET_ROWS`` fingerprints meet, at home or as probes, are cut into blocks, and each pair of blocks
is a task of its own, so no bucket has to fit in one task and no link is lost.

Components come from rounds of alternating star contraction on tables, checkpointed
through the shared folder, until nothing changes.

Null text counts as empty; a text without words has fingerprint zero and is linked
like any other. A component's id is its smallest doc_id; rows that repeat a doc_id
keep one result each. A null doc_id is left out of the smallest ids; a component of
such rows only has a null id. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citemill.llm.catalog import register
from citemill.llm.common import UPPER, staged, table

SHINGLE_WORDS = 4
BITS_MAX = 4
SEED = 42
# First bit, width and radius of each segment; radii plus one add up to BITS_MAX + 1.
SEGMENTS = ((0, 22, 1), (22, 22, 1), (44, 20, 0))
BUCKET_ROWS = 8192
COMPARED = 1 << 22
_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """The fingerprint of one text."""
    tokens = text.encode().translate(_LOWER).split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(words, len(tokens))
    digest = xxhash.xxh64_intdigest
    count = len(tokens) - width + 1
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts[:count].tolist(), ends[width - 1 :].tolist())),
        "<u8",
        count,
    )
    ones = np.zeros(64, np.int64)
    for block in range(0, count, 65_536):
        part = hashes[block : block + 65_536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t or "") for t in batch.column(1).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(prints.view(np.int64))], ["row", "print"]
        )


def fingerprints(docs: DataFrame, place: str | None = None) -> DataFrame:
    """row and print, the fingerprint as a signed 64-bit number.

    ``row`` orders rows: those without a doc_id last, then by doc_id and, where given, place.
    """
    doc_id = F.col("doc_id").cast("long")
    parts = [doc_id.isNull().alias("last"), doc_id.alias("doc_id"), *([F.col(place).alias("place")] if place else [])]
    slim = docs.select(F.struct(*parts).alias("row"), "text")
    schema = T.StructType([slim.schema["row"], T.StructField("print", T.LongType())])
    return slim.mapInArrow(_fingerprints, schema)


def ball(values: np.ndarray, width: int, radius: int) -> np.ndarray:
    """All values within the radius (0 or 1) of each value, itself first."""
    masks = np.concatenate([[0], 1 << np.arange(width)]) if radius else np.zeros(1, np.int64)
    return values[:, None] ^ masks[None, :].astype(np.uint64)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint at home in its own bucket of each table, and as a probe in the ball's others."""
    for batch in batches:
        signed = batch.column(0).to_numpy()
        prints = signed.view(np.uint64)
        for number, (first, width, radius) in enumerate(SEGMENTS):
            own = (prints >> np.uint64(first)) & np.uint64((1 << width) - 1)
            around = ball(own, width, radius)
            size = around.shape[1]
            bucket = (np.uint64(number << 32) | around).astype(np.int64)
            home = np.zeros(around.shape, bool)
            home[:, 0] = True
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket.ravel()), pa.array(np.repeat(signed, size)), pa.array(home.ravel())],
                ["bucket", "print", "home"],
            )


class Forest:
    """Union-find over the places of an array."""

    def __init__(self, size: int):
        self.parent = list(range(size))

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def links(rows: np.ndarray, homes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of all links between ``rows`` and ``homes``, compared in blocks."""
    values, at = np.unique(np.concatenate([rows, homes]), return_inverse=True)
    row_at, home_at = at[: len(rows)], at[len(rows) :]
    forest, found = Forest(len(values)), []
    step = max(1, COMPARED // max(1, len(homes)))
    for begin in range(0, len(rows), step):
        part = rows[begin : begin + step]
        near = np.bitwise_count(part[:, None] ^ homes[None, :]) <= BITS_MAX
        # A row's links to one another's homes: each joins the row's tree once.
        for i, j in zip(*(x.tolist() for x in np.nonzero(near))):
            a, b = int(row_at[begin + i]), int(home_at[j])
            if a != b and forest.join(a, b):
                found.append((a, b))
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return values[pairs[:, 0]], values[pairs[:, 1]]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows sorted by bucket; a bucket may continue in the next batch."""
    names = ["a", "b"]

    def compare(bucket: np.ndarray, prints: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
        edges = np.flatnonzero(np.diff(bucket)) + 1
        begins, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(bucket)]])
        n_home = np.add.reduceat(home.astype(np.int64), begins)
        left, right = [], []
        for g in np.flatnonzero((n_home > 0) & (ends - begins > 1)).tolist():
            rows = prints[begins[g] : ends[g]]
            homes = rows[home[begins[g] : ends[g]]]
            a, b = links(rows, homes) if len(rows) > 64 else _small(rows, homes)
            left.append(a)
            right.append(b)
        arrays = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (left, right)]
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in arrays], names)

    held: list[np.ndarray] | None = None
    for batch in batches:
        now = [
            batch.column(0).to_numpy(),
            batch.column(1).to_numpy().view(np.uint64),
            batch.column(2).to_numpy(zero_copy_only=False),
        ]
        if held is not None:
            now = [np.concatenate(pair) for pair in zip(held, now)]
        if not len(now[0]):
            continue
        last = int(np.searchsorted(now[0], now[0][-1]))
        held = [x[last:] for x in now]
        if last:
            yield compare(*(x[:last] for x in now))
    if held is not None and len(held[0]):
        yield compare(*held)


def _small(rows: np.ndarray, homes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distance = np.bitwise_count(rows[:, None] ^ homes[None, :])
    i, j = np.nonzero((distance <= BITS_MAX) & (distance > 0))
    return rows[i], homes[j]


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's home rows as what they bring to each bucket of their ball."""
    for batch in batches:
        bucket, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for number, (_, width, radius) in enumerate(SEGMENTS):
            own = bucket >> 32 == number
            around = ball((bucket[own] & 0xFFFFFFFF).astype(np.uint64), width, radius)
            reached = (np.uint64(number << 32) | around).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(reached.ravel()), pa.array(np.repeat(rows[own], reached.shape[1]))], ["bucket", "rows"]
            )


def crowded_buckets(homes: DataFrame) -> DataFrame:
    """bucket and rows of the buckets in which more than BUCKET_ROWS rows meet, homes and probes together.

    ``homes`` has the number of home rows of each bucket. Probes come from the buckets of
    a ball, so a crowded bucket has a dense one around it, and only what the dense ones
    bring is added up; what the others bring is less than BUCKET_ROWS in all.
    """
    most = 1 + max(width for _, width, radius in SEGMENTS if radius)
    dense = homes.where(F.col("rows") * most > BUCKET_ROWS)
    met = dense.mapInArrow(_spread, "bucket long, rows long").groupBy("bucket").agg(F.sum("rows").alias("rows"))
    # Nothing is compared in a bucket without a home row.
    return met.where(F.col("rows") > BUCKET_ROWS).join(homes.select("bucket"), "bucket", "left_semi")


def near_links(prints: DataFrame) -> DataFrame:
    """Links a, b that connect all fingerprints within BITS_MAX bits of each other.

    ``prints`` is a written table of different fingerprints (column ``print``).
    """
    entries = prints.select("print").mapInArrow(_entries, "bucket long, print long, home boolean")
    large = staged(crowded_buckets(entries.where("home").groupBy("bucket").agg(F.count("*").alias("rows"))), "large-buckets")
    if large.isEmpty():
        return entries.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_meet, "a long, b long")
    marked = entries.join(large, "bucket", "left")
    small = marked.where(F.col("rows").isNull())
    blocks = F.ceil(F.col("rows") / BUCKET_ROWS)
    own = F.pmod(F.xxhash64("print"), blocks)
    # A home meets every block of its bucket's rows, a row every block of homes: one task a pair of blocks.
    cut = marked.where(F.col("rows").isNotNull()).withColumn("own", own)
    all_blocks = F.sequence(F.lit(0).cast("long"), blocks - 1)
    as_home = cut.where("home").withColumn("j", F.col("own")).withColumn("i", F.explode(all_blocks))
    as_row = cut.withColumn("i", F.col("own")).withColumn("j", F.explode(all_blocks))
    pairs = as_row.withColumn("home", F.lit(False)).unionByName(as_home).select(
        F.xxhash64("bucket", "i", "j").alias("bucket"), "print", "home"
    )
    dealt = small.select("bucket", "print", "home").unionByName(pairs)
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_meet, "a long, b long")


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links as stars: every node of a tree linked to its smallest."""
    arrays = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not arrays:
        return
    a, b = (np.concatenate(x) for x in zip(*arrays))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    forest = Forest(len(nodes))
    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
        forest.join(x, y)
    roots = np.array([forest.root(i) for i in range(len(nodes))], np.int64)
    moved = np.flatnonzero(roots != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[roots[moved]])], ["a", "b"])


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """node and root, the smallest node of its component, for every node that has a link.

    ``edges`` has columns a and b. First each task contracts its own links; then
    large and small stars alternate: neighbours above a node, and then those below
    it, are linked to the smallest node seen. A table is written each round. Joins
    are on slim rows, and a node with very many links is split by the adaptive join.
    """

    def stars(links_: DataFrame, large: bool) -> DataFrame:
        both = links_.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionByName(links_.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        joined = both.join(least.hint("merge"), "u")
        if large:
            moved = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
                least.select(F.col("u").alias("a"), F.col("m").alias("b"))
            )
        return moved.where("a <> b").distinct()

    def signature(links_: DataFrame):
        return links_.agg(
            F.count("*").alias("n"),
            F.bit_xor(F.xxhash64("a", "b")).alias("x"),
        ).first()

    forward = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = staged(forward.mapInArrow(_contract, "a long, b long").distinct(), "links")
    seen = signature(current)
    for _ in range(rounds):
        current = staged(stars(stars(current, large=True), large=False), "stars")
        now = signature(current)
        if now == seen:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
    raise RuntimeError(f"components still change after {rounds} rounds")


def near_groups(docs: DataFrame, place: str | None = None) -> DataFrame:
    """doc_id, print, component_id and kept of every document.

    ``kept`` marks the rows with the smallest doc_id of their component. ``place``
    names a column that tells all rows apart; it comes along, and one row is kept then.
    """
    marked = staged(fingerprints(docs, place), "fingerprints")
    prints = staged(
        marked.groupBy("print").agg(F.min("row").alias("first")), "different-fingerprints"
    )
    found = components(near_links(prints))
    rooted = prints.join(found, F.col("print") == F.col("node"), "left").select(
        "print", F.coalesce("root", "print").alias("root"), "first"
    )
    rooted = staged(rooted, "rooted-fingerprints")
    smallest = staged(rooted.groupBy("root").agg(F.min("first").alias("first")), "smallest-rows")
    named = rooted.drop("first").join(smallest.hint("merge"), "root").select("print", "first")
    return marked.join(named.hint("merge"), "print").select(
        "row.doc_id",
        "print",
        F.col("first.doc_id").alias("component_id"),
        F.col("row").eqNullSafe(F.col("first")).alias("kept"),
        *([F.col("row.place").alias(place)] if place else []),
    )


@register("op8_simhash_balls")
def op8_simhash_balls(spark: SparkSession, folder: str) -> DataFrame:
    groups = near_groups(table(spark, folder, "documents"))
    return groups.select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )
