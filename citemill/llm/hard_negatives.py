"""Hard negatives by an inverted multi-index.

An anchor's positives are its nearest other rows of the same label. For each positive
the nearest rows of other labels are wanted whose score lies in a window below the
positive's own score. Scores are inner products of integer vectors, so all results
are exact.

Vectors are cut into two halves, each with a codebook of its own, fitted by k-means on
a bounded sample. A pair of codes is a cell. For an anchor, a code's bound is the
anchor half's product with the centre plus its length times the code's radius, the
greatest distance of a row's half from its centre; the bounds of a cell's two codes add
up to no less than the score of any row in it. A heap visits the cells in the order of
their bounds, from the two sorted lists of code bounds, and the search stops when the
next bound certifies that no cell left can change the result: it is below the last
score needed, or below the window.

All rows are indexed. Rows are dealt by a hash of their place in the table to shards of
about ``SHARD_ROWS`` rows, so that no label, vector or cell is too large for a task, and
anchors go to every shard in blocks of about ``ANCHOR_ROWS``; a pair of shard and block
is one task, whose shard has its own cells and radii. Each task answers with as many
rows an anchor as are wanted, and the answers of all shards are merged: first for the
positives, then, with their scores, for the windows.

Rows with a null label, a null vector or a component that is null or not finite take
no part, and neither do vectors of another length than most have (of two such lengths
the greater). Null ids are no anchors and lose all ties. Rows that repeat an id are
rows of their own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citemill.llm.catalog import register
from citemill.llm.common import staged, table, with_place

CODES = 16
STEPS = 8
# Rows, in expectation, that the codebooks are fitted on.
SAMPLE_ROWS = 20_000
SHARD_ROWS = 8192
ANCHOR_ROWS = 1024
# Rows that are scored before the certificate is looked at again.
VISITED_ROWS = 512
SCALE = 256
POSITIVES = 5
NEGATIVES = 3
# The window in hundredths of the positive's score.
LOW, HIGH = 50, 95
ANSWER_SCHEMA = "anchor long, anchor_id long, target int, vec_id long, at long, score long"


def participants(rows: DataFrame) -> DataFrame:
    """vec_id, label, vector (array of integers as double) and at (tells rows apart) of the rows that take part."""
    value = F.col("embedding").cast("array<double>")
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists(
        value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    )
    placed = with_place(rows.select("vec_id", "label", "embedding"), "place")
    found = placed.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.transform(value, lambda x: F.floor(x * SCALE).cast("double")).alias("vector"),
        F.col("place"),
        usable.alias("usable"),
    ).where(F.coalesce("usable", F.lit(False)))
    sizes = found.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    size = most["size"] if most else 0
    # One number for a row's place: a written column, so that it is the same at every read.
    return staged(
        found.where(F.size("vector") == size)
        .select("vec_id", "label", "vector", F.xxhash64("place").alias("dealt"), F.monotonically_increasing_id().alias("at")),
        "vectors",
    )


def relabelled(rows: DataFrame) -> DataFrame:
    """The contract's labels: of every seventh id the next one."""
    other = F.col("vec_id").isNotNull() & (F.col("vec_id") % 7 == 0)
    return rows.withColumn("label", F.when(other, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def fit_codebook(points: np.ndarray, codes: int = CODES, steps: int = STEPS) -> np.ndarray:
    """Centres of k-means, starting from points spread over the sample in the order of their sums."""
    if not len(points):
        return np.zeros((1, points.shape[1]))
    order = np.argsort(points.sum(axis=1), kind="stable")
    centres = np.unique(points[order[np.linspace(0, len(points) - 1, codes).astype(int)]], axis=0)
    for _ in range(steps):
        nearest = nearest_codes(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        counts = np.bincount(nearest, minlength=len(centres))
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest_codes(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each point."""
    return np.argmin((centres**2).sum(axis=1) - 2 * points @ centres.T, axis=1)


def fit_codebooks(rows: DataFrame, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Codebooks of the two halves, from a hashed sample of about ``SAMPLE_ROWS`` rows."""
    share = min(1.0, SAMPLE_ROWS / max(1, n_rows))
    chosen = F.pmod(F.xxhash64("dealt", F.lit("sample")), F.lit(1 << 20)) < int(share * (1 << 20))
    sample = [r.vector for r in rows.where(chosen).orderBy("dealt", "at").select("vector").collect()]
    points = np.array(sample, np.float64) if sample else np.zeros((0, 2))
    half = points.shape[1] // 2
    return fit_codebook(points[:, :half]), fit_codebook(points[:, half:])


class Shard:
    """The multi-index of one shard's rows."""

    def __init__(self, vectors: np.ndarray, books: tuple[np.ndarray, np.ndarray]):
        half = books[0].shape[1]
        self.books, self.half = books, half
        parts = vectors[:, :half], vectors[:, half:]
        codes = [nearest_codes(part, book) for part, book in zip(parts, books)]
        self.radii = []
        for part, book, code in zip(parts, books, codes):
            radius = np.full(len(book), -np.inf)
            np.maximum.at(radius, code, np.sqrt(((part - book[code]) ** 2).sum(axis=1)))
            self.radii.append(radius)
        cell = codes[0] * len(books[1]) + codes[1]
        self.order = np.argsort(cell, kind="stable")
        self.vectors = vectors[self.order]
        self.begin = np.searchsorted(cell[self.order], np.arange(len(books[0]) * len(books[1]) + 1))

    def code_bounds(self, anchor: np.ndarray) -> list[np.ndarray]:
        """Upper bounds of an anchor half's product with any row half of each code."""
        found = []
        for part, book, radius in zip((anchor[: self.half], anchor[self.half :]), self.books, self.radii):
            used = np.isfinite(radius)
            bound = book @ part + np.sqrt(part @ part) * np.where(used, radius, 0)
            # Room for rounding.
            found.append(np.where(used, bound + 1e-9 * (np.abs(bound) + 1), -np.inf))
        return found

    def visit(self, anchor: np.ndarray) -> Iterator[tuple[float, list[tuple[int, int]]]]:
        """Cells in the order of their bounds, in batches: the bound of what comes next, and row ranges."""
        first, second = self.code_bounds(anchor)
        rank_a, rank_b = np.argsort(-first, kind="stable").tolist(), np.argsort(-second, kind="stable").tolist()
        a, b = first.tolist(), second.tolist()
        begin, width = self.begin, len(b)
        heap = [(-(a[rank_a[0]] + b[rank_b[0]]), 0, 0)]
        ranges: list[tuple[int, int]] = []
        rows = 0
        while heap:
            bound, i, j = heapq.heappop(heap)
            if bound == np.inf:
                break
            if rows >= VISITED_ROWS:
                yield -bound, ranges
                ranges, rows = [], 0
            cell = rank_a[i] * width + rank_b[j]
            start, end = int(begin[cell]), int(begin[cell + 1])
            if end > start:
                ranges.append((start, end))
                rows += end - start
            # Each cell is reached once: along its row from the first column, down that column from the top.
            if j + 1 < width:
                heapq.heappush(heap, (-(a[rank_a[i]] + b[rank_b[j + 1]]), i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (-(a[rank_a[i + 1]] + b[rank_b[0]]), i + 1, 0))
        yield -np.inf, ranges

    def scores(self, anchor: np.ndarray, ranges: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Places, in the shard's own order, and scores of the rows in the ranges."""
        places = np.concatenate([np.arange(start, end) for start, end in ranges]) if ranges else np.zeros(0, np.int64)
        return places, (self.vectors[places] @ anchor).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, at: np.ndarray, wanted: int) -> np.ndarray:
    """Places of the best: by score, then the smaller id, then the earlier row."""
    return np.lexsort((at, ids, -scores))[:wanted]


def _answers(rows: pd.DataFrame, anchors: pd.DataFrame, books: tuple[np.ndarray, np.ndarray], wanted: int) -> pd.DataFrame:
    """For each anchor's targets, windows of scores, the best rows of this shard.

    A target is (number, same label or another, low, high); rows qualify with a score
    in its window and are wanted from the greatest on.
    """
    names = [part.split()[0] for part in ANSWER_SCHEMA.split(", ")]
    if not len(rows) or not len(anchors):
        return pd.DataFrame(columns=names).astype("int64").astype({"vec_id": "Int64", "target": "int32"})
    shard = Shard(np.stack(rows["vector"].to_numpy()).astype(np.float64), books)
    ids = rows["vec_id"].astype("Int64")
    # A null id loses ties.
    compared = ids.fillna(np.iinfo(np.int64).max).to_numpy(np.int64)[shard.order]
    at, labels = rows["at"].to_numpy()[shard.order], rows["label"].to_numpy()[shard.order]
    found = []
    for anchor in anchors.itertuples(index=False):
        vector = np.asarray(anchor.vector, np.float64)
        held = {t["number"]: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for t in anchor.targets}
        for rest, ranges in shard.visit(vector):
            places, scores = shard.scores(vector, ranges)
            same = labels[places] == anchor.label
            certified = True
            for t in anchor.targets:
                fit = np.flatnonzero((same == t["same"]) & (scores >= t["low"]) & (scores <= t["high"]) & (at[places] != anchor.at))
                own, values = held[t["number"]]
                if len(fit):
                    own, values = np.concatenate([own, places[fit]]), np.concatenate([values, scores[fit]])
                    top = best(values, compared[own], at[own], wanted)
                    own, values = own[top], values[top]
                    held[t["number"]] = own, values
                # Nothing below the window counts, and nothing below the last row wanted.
                needed = max(t["low"], int(values[-1]) if len(values) == wanted else t["low"])
                certified &= rest < needed
            if certified:
                break
        for number, (own, values) in held.items():
            found += [(anchor.at, anchor.vec_id, number, compared[p], at[p], v) for p, v in zip(own.tolist(), values.tolist())]
    result = pd.DataFrame(found, columns=names).astype("int64")
    null = result["vec_id"] == np.iinfo(np.int64).max
    return result.astype({"vec_id": "Int64", "target": "int32"}).assign(vec_id=lambda r: r["vec_id"].mask(null & ids.isna().any()))


def search(rows: DataFrame, anchors: DataFrame, books: tuple[np.ndarray, np.ndarray], shards: int, blocks: int, wanted: int) -> DataFrame:
    """anchor (its at), anchor_id, target, vec_id, at, score of the ``wanted`` best rows of each target.

    ``anchors`` has vec_id, at, label, vector and targets, an array of (number, same, low, high).
    """
    shared = rows.sparkSession.sparkContext.broadcast(books)
    block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = rows.select("vec_id", "label", "vector", "at", F.pmod(F.col("dealt"), F.lit(shards)).cast("int").alias("shard"), block.alias("block"))
    asked = anchors.select(
        "vec_id", "label", "vector", "at", "targets",
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
        F.pmod(F.xxhash64("at"), F.lit(blocks)).cast("int").alias("block"),
    )

    def task(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _answers(left, right, shared.value, wanted)

    answers = dealt.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(task, ANSWER_SCHEMA)
    order = Window.partitionBy("anchor", "target").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "at")
    return answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted)


def _target(number: Column, same: bool, low: Column, high: Column) -> Column:
    return F.struct(
        number.cast("int").alias("number"), F.lit(same).alias("same"), low.cast("long").alias("low"), high.cast("long").alias("high")
    )


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    shard_rows: int = SHARD_ROWS,
    anchor_rows: int = ANCHOR_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` is a written table of ``participants`` form. Windows are of integers:
    LOW * positive <= 100 * negative <= HIGH * positive.
    """
    n_rows = rows.count()
    anchors = staged(rows.where(F.coalesce(is_anchor, F.lit(False))), "anchors")
    n_anchors = anchors.count()
    books = fit_codebooks(rows, n_rows)
    shards, blocks = max(1, -(-n_rows // shard_rows)), max(1, -(-n_anchors // anchor_rows))
    all_scores = F.lit(-(1 << 62)), F.lit(1 << 62)
    asked = anchors.withColumn("targets", F.array(_target(F.lit(0), True, *all_scores)))
    nearest = staged(search(rows, asked, books, shards, blocks, positives), "positives")
    low = F.ceil(F.col("score") * LOW / F.lit(100))
    high = F.floor(F.col("score") * HIGH / F.lit(100))
    windows = (
        nearest.where(F.col("score") >= 0)  # a negative score has an empty window
        .groupBy("anchor")
        .agg(F.collect_list(_target(F.col("rank"), False, low, high)).alias("targets"))
    )
    joined = anchors.join(windows, F.col("at") == F.col("anchor")).drop("anchor")
    found = search(rows, joined, books, shards, blocks, negatives)
    named = nearest.select(
        F.col("anchor"), F.col("rank").alias("target"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    return found.join(named, ["anchor", "target"]).select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("vec_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )


SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (
  SELECT p.*, s.other_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other_id) AS n_rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
    AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(n_rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE n_rank <= 3
"""


@register("op12_hard_negatives", SQL)
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = staged(relabelled(participants(table(spark, folder, "embeddings"))), "relabelled")
    return hard_negatives(rows, F.col("vec_id") % 50 == 0)
