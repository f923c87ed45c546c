"""Line dedup: a sharded minimal perfect hash over the hashes of frequent lines.

Each line's key is hashed to 128 bits. Spark counts the documents per hash; hashes
that reach the limit are dealt to shards by their bits, and each shard is a minimal
perfect hash with three arrays: fingerprint, count and owner (the largest doc_id).
Shards are written to the shared folder. Documents are read once more; a task hashes
its lines, visits the shards one after another and probes the arrays, so no line is
joined with anything and no text is shuffled.

A probe that misses the index is refuted by the stored 64-bit fingerprint; the other
64 bits choose shard and slot. Sizes: 20 bytes an indexed line plus about 4 bits.
A task holds one buffer of texts and a bounded number of shards.

Null or empty text is one empty line. A row is a document: rows that repeat a
doc_id each count, and all rows with the owner's doc_id keep the line. A null doc_id
is below all others.
"""

from __future__ import annotations

import math
import re
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citemill.llm.catalog import register
from citemill.llm.common import UPPER, delete_on_exit, staged, table
from citemill.session import scratch_path

KEY_MIN = 40
DOCUMENTS_MIN = 5
SHARD_KEYS = 200_000
SLOTS_PER_KEY = 2
LEVELS_MAX = 64
BUFFER_CHARS = 12_000_000
SHARDS_HELD = 8
NO_ID = -(1 << 63)

_BLANKS = b" \t\n\x0b\x0c\r"
_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FIRST, _SECOND = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def line_key(line: bytes) -> bytes:
    return line.strip(_BLANKS).translate(_LOWER)


def long_enough(key: bytes) -> bool:
    """At least 40 code points."""
    return len(key) >= KEY_MIN and (len(key) >= 4 * KEY_MIN or len(key.decode()) >= KEY_MIN)


def key_hashes(lines: list[bytes]) -> tuple[list[int], list[int]]:
    """Places of the lines that have a key, and the 128-bit hashes of the keys."""
    places, hashes = [], []
    for i, line in enumerate(lines):
        if len(line) >= KEY_MIN and long_enough(key := line_key(line)):
            places.append(i)
            hashes.append(xxhash.xxh3_128_intdigest(key))
    return places, hashes


def halves(hashes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    packed = b"".join(h.to_bytes(16, "little") for h in hashes)
    both = np.frombuffer(packed, "<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def mixed(high: np.ndarray, low: np.ndarray, level: int) -> np.ndarray:
    """A fresh 64-bit hash of the 128 bits for each level."""
    with np.errstate(over="ignore"):
        x = high ^ (low + _MIX * np.uint64(2 * level + 1))
        x = (x ^ (x >> np.uint64(30))) * _FIRST
        x = (x ^ (x >> np.uint64(27))) * _SECOND
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Distinct keys to the numbers 0 to n-1, by levels of bit arrays.

    On each level a key that shares its bit with no other key takes it; the others
    go on to the next level. A key's number is the rank of its bit.
    """

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.starts = np.concatenate([[0], np.cumsum([s // 64 for s in sizes])]).astype(np.int64)
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words))]).astype(np.int64)

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray) -> PerfectHash:
        sizes, levels, left = [], [], np.arange(len(high))
        while len(left):
            if len(sizes) == LEVELS_MAX:
                raise ValueError("keys of a perfect hash must be distinct")
            size = 64 * math.ceil(max(1, SLOTS_PER_KEY * len(left)) / 64)
            at = (mixed(high[left], low[left], len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[at]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, "<u8"))

    def find(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Numbers of the keys; -1 where a key surely was not among those built."""
        numbers, left = np.full(len(high), -1, np.int64), np.arange(len(high))
        for level, size in enumerate(self.sizes):
            at = (mixed(high[left], low[left], level) % np.uint64(size)).astype(np.int64)
            word, bit = self.starts[level] + (at >> 6), (at & 63).astype(np.uint64)
            found = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            numbers[left[found]] = (self.ranks[word] + np.bitwise_count(below))[found]
            left = left[~found]
        return numbers


class Shard:
    """A perfect hash and its fingerprint, count and owner arrays."""

    def __init__(self, perfect: PerfectHash, prints: np.ndarray, counts: np.ndarray, owners: np.ndarray):
        self.perfect, self.prints, self.counts, self.owners = perfect, prints, counts, owners

    @classmethod
    def build(cls, high, low, counts, owners) -> Shard:
        perfect = PerfectHash.build(high, low)
        order = np.empty(len(high), np.int64)
        order[perfect.find(high, low)] = np.arange(len(high))
        return cls(perfect, low[order], counts[order], owners[order])

    def probe(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each key the count (0: not indexed) and the owner."""
        at = self.perfect.find(high, low)
        known = at >= 0
        known[known] = self.prints[at[known]] == low[known]
        counts, owners = np.zeros(len(high), np.int64), np.full(len(high), NO_ID, np.int64)
        counts[known], owners[known] = self.counts[at[known]], self.owners[at[known]]
        return counts, owners

    def row(self, number: int) -> dict:
        return {
            "number": number,
            "sizes": np.array(self.perfect.sizes, "<i8").tobytes(),
            "words": self.perfect.words.tobytes(),
            "prints": self.prints.astype("<u8").tobytes(),
            "counts": self.counts.astype("<i8").tobytes(),
            "owners": self.owners.astype("<i8").tobytes(),
        }

    @classmethod
    def of_row(cls, row: dict) -> Shard:
        sizes = np.frombuffer(row["sizes"], "<i8").tolist()
        return cls(
            PerfectHash(sizes, np.frombuffer(row["words"], "<u8")),
            np.frombuffer(row["prints"], "<u8"),
            np.frombuffer(row["counts"], "<i8"),
            np.frombuffer(row["owners"], "<i8"),
        )


SHARD_SCHEMA = "number int, sizes binary, words binary, prints binary, counts binary, owners binary"


def _lines_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split(b"\n")


def _hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, ids = [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = set(key_hashes(_lines_of(text))[1])
            hashes += own
            ids += [NO_ID if doc_id is None else doc_id] * len(own)
        high, low = halves(hashes)
        yield pa.RecordBatch.from_arrays(
            [pa.array(high.view("<i8")), pa.array(low.view("<i8")), pa.array(ids, pa.int64())],
            ["high", "low", "id"],
        )


def frequent_lines(docs: DataFrame, documents: int = DOCUMENTS_MIN) -> DataFrame:
    """high, low, n, owner of every line key found in at least ``documents`` documents.

    A document sends each of its keys once; tasks add up before the shuffle, so a
    line that all documents share is one row per task.
    """
    hashed = docs.select("doc_id", "text").mapInArrow(_hash_lines, "high long, low long, id long")
    counted = hashed.groupBy("high", "low").agg(F.count("*").alias("n"), F.max("id").alias("owner"))
    return counted.where(F.col("n") >= documents)


def _build_shard(key: tuple, rows: pa.Table) -> pa.Table:
    shard = Shard.build(
        rows.column("high").to_numpy().view("<u8"),
        rows.column("low").to_numpy().view("<u8"),
        rows.column("n").to_numpy(),
        rows.column("owner").to_numpy(),
    )
    return pa.Table.from_pylist([shard.row(key[0].as_py())], schema=pa.schema(
        [("number", pa.int32())] + [(n, pa.binary()) for n in ("sizes", "words", "prints", "counts", "owners")]
    ))


def shard_number(high, shards: int):
    """A key's shard, from the upper half of its hash; the same in Spark and numpy."""
    if isinstance(high, np.ndarray):
        return ((high >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
    return (F.shiftrightunsigned(high, 32) % shards).cast("int")


def build_index(frequent: DataFrame, shard_keys: int = SHARD_KEYS) -> dict[int, str]:
    """Write one file per shard to the shared folder; number and place of each.

    Shards take equal shares of the hashes, so no shard grows beyond its share.
    """
    spark = frequent.sparkSession
    rows = staged(frequent, "frequent-lines")
    shards = max(1, math.ceil(rows.count() / shard_keys))
    built = (
        rows.withColumn("number", shard_number(F.col("high"), shards))
        .groupBy("number")
        .applyInArrow(_build_shard, SHARD_SCHEMA)
        .withColumn("shard", F.col("number"))
    )
    path = scratch_path(spark, "line-index")
    built.write.partitionBy("shard").parquet(path)
    delete_on_exit(spark, path)
    files = spark.read.schema(SHARD_SCHEMA).parquet(path).inputFiles()
    places = {int(re.search(r"/shard=(\d+)/", f)[1]): f for f in files}
    return {number: places.get(number, "") for number in range(shards)}


class _ShardReader:
    """The shards a task used last."""

    def __init__(self, places: dict[int, str], held: int = SHARDS_HELD):
        self.places, self.held, self.open = places, held, OrderedDict()

    def get(self, number: int) -> Shard | None:
        if not self.places[number]:
            return None
        if number in self.open:
            self.open.move_to_end(number)
            return self.open[number]
        system, path = pyarrow.fs.FileSystem.from_uri(self.places[number])
        with system.open_input_file(path) as source:
            shard = Shard.of_row(pq.ParquetFile(source).read().to_pylist()[0])
        while len(self.open) >= self.held:
            self.open.popitem(last=False)
        self.open[number] = shard
        return shard


def _drop_lines(ids: list, bodies: list, reader: _ShardReader) -> pa.RecordBatch:
    lines = [_lines_of(text) for text in bodies]
    places, hashes, owner_of = [], [], []
    for d, own in enumerate(lines):
        at, found = key_hashes(own)
        places += at
        hashes += found
        owner_of += [d] * len(at)
    high, low = halves(hashes)
    number = shard_number(high, len(reader.places))
    counts, owners = np.zeros(len(high), np.int64), np.full(len(high), NO_ID, np.int64)
    order = np.argsort(number, kind="stable")
    for chosen in np.split(order, np.flatnonzero(np.diff(number[order])) + 1):
        shard = reader.get(int(number[chosen[0]])) if len(chosen) else None
        if shard is not None:
            counts[chosen], owners[chosen] = shard.probe(high[chosen], low[chosen])
    own_ids = np.array([NO_ID if i is None else i for i in ids], np.int64)
    dropped = np.flatnonzero((counts > 0) & (owners != own_ids[np.array(owner_of, np.int64)]))
    gone: list[set] = [set() for _ in ids]
    for i in dropped.tolist():
        gone[owner_of[i]].add(places[i])
    kept = [
        b"\n".join(line for i, line in enumerate(own) if i not in out) if out else b"\n".join(own)
        for own, out in zip(lines, gone)
    ]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array([len(own) for own in lines], pa.int64()),
            pa.array([len(out) for out in gone], pa.int64()),
            pa.array([k.decode() for k in kept], pa.string()),
        ],
        ["doc_id", "n_lines", "n_dropped", "kept_text"],
    )


def drop_frequent_lines(docs: DataFrame, places: dict[int, str]) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_text of every document, by probing the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, ids, bodies, held = _ShardReader(places), [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(doc_id)
                bodies.append(text)
                held += len(text or "")
                if held >= BUFFER_CHARS:
                    yield _drop_lines(ids, bodies, reader)
                    ids, bodies, held = [], [], 0
        if ids:
            yield _drop_lines(ids, bodies, reader)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_lines long, n_dropped long, kept_text string"
    )


def dedup_lines(docs: DataFrame, documents: int = DOCUMENTS_MIN, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """Count, index, probe: the whole operator."""
    return drop_frequent_lines(docs, build_index(frequent_lines(docs, documents), shard_keys))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d),
k AS (SELECT *, translate(trim(line, E' \t\n\x0b\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT r) >= 5),
m AS (SELECT k.*, f.owner IS NOT NULL AND f.owner <> doc_id AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""


@register("op2_line_index", SQL)
def op2_line_index(spark: SparkSession, folder: str) -> DataFrame:
    kept = dedup_lines(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
