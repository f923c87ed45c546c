r"""Periodic runs of words, found in tiles per period octave.

A run is a stretch of words that repeats with a smallest period q, is at least
max(6, 4 q) long and cannot be extended. Periods are taken in octaves [P/2, P). The
places i with word i equal to word i + q are the period's matches; a run's matches
lie side by side, 1.5 P of them at least, so one of the boundaries at the multiples
of P is among them, and on one side of it half of P matches follow one another.

A boundary is looked at closely only where a hash of the half P words beside it is
found again q words on. There two Z-functions, of the words after it and of those
before it, read backwards, give for all periods at once how far matches go on in each
direction. A period whose root is a power of a shorter word is not the smallest and
is left out. The pieces that neighbouring boundaries see of one run overlap, and are
stitched by document and period.

A document of up to ``LONG_BYTES`` is a single tile and is solved where it is read.
Longer ones are exploded into tiles: the octaves up to ``TILE_WORDS`` / 8 share tiles
of that many words, each longer octave has tiles of 4 P words, with P words more before
and 2 P after. Tiles are dealt over all tasks, solved on their own, and their
fragments are shuffled by document and period, where touching intervals become one.

Words are runs of other characters than ``[\x20\x09-\x0D]``. Null text has no words;
rows that repeat a doc_id count one by one; an empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citemill.llm.catalog import register
from citemill.llm.common import WORD, slices, staged, table, texts, with_place

LENGTH_MIN = 6
EXPONENT_MIN = 4
LONG_BYTES = 1 << 16
TILE_WORDS = 1 << 13
SLICE_BYTES = 1 << 21
_FACTOR = 0x9E3779B97F4A7C15
RUN_SCHEMA = "start long, length long, period long"
SUMMARY_SCHEMA = (
    "doc_id long, n_words long, n_runs long, start long, length long, period long,"
    " runs_sha256 string, collapsed_sha256 string"
)
TILE_SCHEMA = "place struct<file:long,at:long>, low int, high int, begin long, owned long, first long, n_words long, codes binary"
FRAGMENT_SCHEMA = "place struct<file:long,at:long>, period long, begin long, end long"


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as many as were asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    @staticmethod
    def _powers(factor: int, length: int) -> np.ndarray:
        found = np.full(length, factor, np.uint64)
        found[0] = 1
        return np.cumprod(found, dtype=np.uint64)

    def get(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < size:
            length = 1 << (size - 1).bit_length()
            self.up, self.down = (self._powers(f, length) for f in (_FACTOR, pow(_FACTOR, -1, 1 << 64)))
        return self.up[:size], self.down[:size]


_POWERS = Powers()


def mixed(codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of word codes."""
    x = codes.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def hits(hashes: np.ndarray, period_end: int) -> tuple[np.ndarray, np.ndarray]:
    """Boundaries and periods of the octave that ends at ``period_end`` where half of it may match."""
    half, n = period_end // 2, len(hashes)
    m = -(-n // period_end)
    up, down = _POWERS.get(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up[:n], out=sums[1:])
    # Places without a whole window get numbers that nothing equals.
    windows = np.arange(m * period_end, dtype=np.uint64) * np.uint64(_FACTOR)
    if n >= half:
        windows[: n - half + 1] = (sums[half:] - sums[: n - half + 1]) * down[: n - half + 1]
    rows = windows.reshape(m, period_end)
    after = np.nonzero(rows[:, half:] == rows[:, :1])
    before = np.nonzero(rows[1:, :half] == rows[:-1, half : half + 1])
    at = np.concatenate([after[0], before[0] + 1]) * period_end
    periods = np.concatenate([after[1], before[1]]) + half
    both = np.unique(at * (2 * period_end) + periods)
    return both // (2 * period_end), both % (2 * period_end)


def z_function(word: list[int]) -> list[int]:
    """For each place, how many items from there on equal those from the start on."""
    size = len(word)
    z = [0] * size
    if size:
        z[0] = size
    left = right = 0
    for i in range(1, size):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < size and word[k] == word[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def is_power(period: int, z: list[int]) -> bool:
    """Whether the word of that length, whose Z-function is ``z``, is a power of a shorter one."""
    rest, factor = period, 2
    while rest > 1:
        if factor * factor > rest:
            factor = rest
        if rest % factor == 0:
            if z[period // factor] >= period - period // factor:
                return True
            while rest % factor == 0:
                rest //= factor
        factor += 1
    return False


def merged(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Intervals (period, begin, end) with touching ones of a period made one."""
    result: list[tuple[int, int, int]] = []
    for period, begin, end in sorted(found):
        if result and result[-1][0] == period and begin <= result[-1][2]:
            if end > result[-1][2]:
                result[-1] = (period, result[-1][1], end)
        else:
            result.append((period, begin, end))
    return result


def fragments(codes: np.ndarray, hashes: np.ndarray, period_end: int, owned: tuple[int, int] | None = None) -> list[tuple[int, int, int]]:
    """(period, begin, end) of the matches around the octave's boundaries, stitched; ``owned`` bounds the boundaries."""
    at, periods = hits(hashes, period_end)
    if owned:
        inside = (at >= owned[0]) & (at < owned[1])
        at, periods = at[inside], periods[inside]
    found = []
    edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
    for first, last in zip(edges, edges[1:]):
        if first == last:
            continue
        c = int(at[first])
        left = max(0, c - period_end)
        window = codes[left : c + 2 * period_end].tolist()
        right_part = window[c - left :]
        forward = z_function(right_part)
        before = window[: c - left][::-1]
        around = window[: c - left + period_end][::-1]
        # Codes are not negative, so -1 parts the two.
        backward = z_function([*before, -1, *around])
        for q in periods[first:last].tolist():
            if q >= len(right_part) or is_power(q, forward):
                continue
            r = forward[q]
            place = len(before) + 1 + len(around) - (c - left) - q
            k = backward[place] if place < len(backward) else 0
            if r or k:
                found.append((q, c - k, c + r))
    return merged(found)


def octaves(n_words: int) -> list[int]:
    """Ends P of the octaves [P/2, P) with a period that a run in so many words may have."""
    longest = n_words // EXPONENT_MIN if n_words >= LENGTH_MIN else 0
    return [1 << k for k in range(1, longest.bit_length() + 1)]


def long_enough(period: int, begin: int, end: int) -> bool:
    return end - begin + period >= max(LENGTH_MIN, EXPONENT_MIN * period)


def runs_of(words: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each document, by start and period."""
    known: dict[bytes, int] = {}
    sizes = np.array([len(w) for w in words], np.int64)
    arrays = [np.fromiter((known.setdefault(w, len(known)) for w in own), np.int64, len(own)) for own in words]
    found: list[list[tuple[int, int, int]]] = [[] for _ in words]
    for period_end in octaves(int(sizes.max(initial=0))):
        chosen = np.flatnonzero(sizes >= max(LENGTH_MIN, EXPONENT_MIN * (period_end // 2)))
        # Documents side by side, with a code of its own after each.
        parts = [part for i in chosen for part in (arrays[i], [len(known) + i])]
        codes = np.concatenate(parts).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes[chosen] + 1)])
        for period, begin, end in fragments(codes, mixed(codes), period_end):
            if long_enough(period, begin, end):
                k = int(np.searchsorted(starts, begin, "right")) - 1
                found[chosen[k]].append((begin - int(starts[k]), end - begin + period, period))
    return [sorted(own, key=lambda run: (run[0], run[2])) for own in found]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(edges[:-1]) == 0)
    return [words[i] for i in kept.tolist()]


def summary(doc_id: int | None, words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    best = max(runs, key=lambda run: (run[1], -run[0], -run[2]), default=(None, None, None))
    listed = hashlib.sha256()
    for start, length, period in runs:
        listed.update(b"%d,%d,%d\n" % (start, length, period))
    kept = hashlib.sha256(b" ".join(collapsed(words, runs)))
    return doc_id, len(words), len(runs), *best, listed.hexdigest(), kept.hexdigest()


def _summaries(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * 6 + [pa.string()] * 2
    names = [part.split()[0] for part in SUMMARY_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def _solve_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 1, SLICE_BYTES):
            words = [(t or "").encode().split() for t in part.column(1).to_pylist()]
            yield _summaries(list(map(summary, part.column(0).to_pylist(), words, runs_of(words))))


def tiles_of(codes: np.ndarray, tile_words: int = TILE_WORDS) -> Iterator[tuple[int, int, int, int, int, np.ndarray]]:
    """(low, high, begin, owned, first, codes) of a document's tiles.

    A tile holds the codes from ``begin`` on and owns the boundaries from ``first`` to
    ``first`` + ``owned``, for the octaves that end at ``low`` to ``high``.
    """
    ends = octaves(len(codes))
    shared = [p for p in ends if p <= tile_words // 8]
    groups = [(shared[0], shared[-1], tile_words)] if shared else []
    groups += [(p, p, 4 * p) for p in ends if p > tile_words // 8]
    for low, high, size in groups:
        for first in range(0, len(codes), size):
            begin = max(0, first - high)
            yield low, high, begin, size, first, codes[begin : first + size + 2 * high]


def _explode_tiles(tile_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["place", "low", "high", "begin", "owned", "first", "n_words", "codes"]
        for batch in batches:
            for i in range(batch.num_rows):
                known: dict[bytes, int] = {}
                words = (batch.column(1)[i].as_py() or "").encode().split()
                codes = np.fromiter((known.setdefault(w, len(known)) for w in words), "<i4", len(words))
                del words
                for low, high, begin, owned, first, own in tiles_of(codes, tile_words):
                    numbers = [[low], [high], [begin], [owned], [first], [len(codes)]]
                    types = [pa.int32(), pa.int32()] + [pa.int64()] * 4
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(i, 1), *map(pa.array, numbers, types), pa.array([own.tobytes()], pa.binary())],
                        names,
                    )

    return run


def _solve_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            low, high, begin, owned, first, n_words = (batch.column(k)[i].as_py() for k in range(1, 7))
            codes = np.frombuffer(batch.column(7)[i].as_py(), "<i4").astype(np.int64)
            hashes, found = mixed(codes), []
            period_end = low
            while period_end <= high:
                # Boundaries are multiples of P in the document: begin is one, or zero.
                for period, b, e in fragments(codes, hashes, period_end, (first - begin, first - begin + owned)):
                    b, e = b + begin, e + begin
                    inside = b > first and e < first + owned
                    if not inside or long_enough(period, b, e):
                        found.append((period, b, e))
                period_end *= 2
            if found:
                place = batch.column(0).take(pa.array([i] * len(found)))
                columns = [pa.array(c, pa.int64()) for c in zip(*found)]
                yield pa.RecordBatch.from_arrays([place, *columns], ["place", "period", "begin", "end"])


def stitched(found: DataFrame) -> DataFrame:
    """place and runs (sorted structs) of the documents with a run, from the tiles' fragments."""
    own = Window.partitionBy("place", "period").orderBy("begin", "end")
    reach = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("begin") <= F.col("reach"), 0).otherwise(1)).over(own.rowsBetween(Window.unboundedPreceding, 0))
    whole = (
        found.withColumn("reach", reach)
        .withColumn("island", island)
        .groupBy("place", "period", "island")
        .agg(F.min("begin").alias("start"), (F.max("end") - F.min("begin") + F.col("period")).alias("length"))
        .where(F.col("length") >= F.greatest(F.lit(LENGTH_MIN), EXPONENT_MIN * F.col("period")))
    )
    # A text has fewer runs than words, so a document's list is no longer than its text.
    return whole.groupBy("place").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))


def long_runs(docs: DataFrame, tile_words: int = TILE_WORDS) -> DataFrame:
    """place and runs of documents with at least one, by way of tiles. ``docs`` has place and text."""
    tiles = docs.select("place", "text").mapInArrow(_explode_tiles(tile_words), TILE_SCHEMA)
    dealt = tiles.repartition("place", "low", "first")
    return stitched(dealt.mapInArrow(_solve_tiles, FRAGMENT_SCHEMA))


def _summarise_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            words = (batch.column(1)[i].as_py() or "").encode().split()
            runs = [(r["start"], r["length"], r["period"]) for r in batch.column(2)[i].as_py() or []]
            yield _summaries([summary(batch.column(0)[i].as_py(), words, runs)])


def run_summaries(docs: DataFrame, long_bytes: int = LONG_BYTES, tile_words: int = TILE_WORDS) -> DataFrame:
    """doc_id, n_words, n_runs, the longest run (start, length, period) and two digests of every row.

    ``runs_sha256`` is of all runs as lines ``start,length,period`` by start and period,
    ``collapsed_sha256`` of the kept words joined by a space.
    """
    rows = with_place(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), texts(F.col("text")).alias("text")), "place"
    )
    is_long = F.octet_length("text") > long_bytes
    short = rows.where(~is_long).select("doc_id", "text").mapInArrow(_solve_documents, SUMMARY_SCHEMA)
    long_ = rows.where(is_long)
    runs = staged(long_runs(long_, tile_words), "long-runs")
    joined = long_.join(runs, "place", "left").select("doc_id", "text", "runs")
    return short.unionByName(joined.mapInArrow(_summarise_long, SUMMARY_SCHEMA))


def with_periodic_ends(docs: DataFrame) -> DataFrame:
    """doc_id and text, a tenth of the texts with an end that repeats, as the query's contract has them.

    With h the CRC-32 of the decimal doc_id and g = floor(h / 10), where h is divisible
    by 10 the words from a = g % n on repeat the first p of them, p = 1 + floor((n - a) / (3 + g % 8)).
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    # One-element arrays bind what is used more than once.
    words = F.regexp_extract_all(texts(F.col("text")), F.lit(WORD), F.lit(0))

    def changed(w):
        n = F.size(w)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        bound = F.array(F.struct(w.alias("w"), a.alias("a"), p.alias("p"), n.alias("n")))
        return F.transform(
            bound,
            lambda b: F.concat_ws(
                " ",
                F.slice(b["w"], F.lit(1), b["a"]),
                F.transform(
                    F.sequence(b["a"], b["n"] - 1), lambda i: F.get(b["w"], b["a"] + (i - b["a"]) % b["p"])
                ),
            ),
        )[0]

    text = F.when((h % 10 == 0) & F.col("text").rlike(WORD), F.transform(F.array(words), changed)[0])
    return docs.select("doc_id", F.coalesce(text, F.col("text")).alias("text"))


@register("op11_word_runs")
def op11_word_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = with_periodic_ends(table(spark, folder, "documents"))
    exponent = F.floor(F.lit(1000) * F.col("length") / F.col("period"))
    return run_summaries(docs).withColumn("exponent_milli", exponent.cast("long"))
