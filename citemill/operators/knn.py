"""Nearest chunks for whole batches of questions.

No plan here joins every question row with every chunk row. Distances come from
matrix products over Arrow batches, and only a question's best rows leave a task.

* ``nearest_by_broadcast``: the question vectors, checked to be small, travel to
  every task; the chunk table is read once where it lies and is not shuffled.
* ``nearest_by_cells``: for any number of questions. Chunks fall into cells around
  a fixed number of pivots. A question visits only the cells the triangle
  inequality cannot rule out, so results are exact. A task holds a block of questions
  of bounded size and reads its share of the chunks as they come, cell by cell; the
  chunks are shared out by hashed id, so one crowded cell is spread over many tasks.
* ``nearest_in_probed_cells``: the same, visiting just the closest few cells;
  approximate.

Distances are compared at nine decimals (far below float noise in the vectors),
ties by chunk id, so copies of one vector come in a fixed order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citemill.functions import fixed_values as fixed

DECIMALS = 9
MAX_BROADCAST_BYTES = 64 << 20
MAX_BROADCAST_QUESTIONS = 8192
# Rows of one matrix product: chunks and questions.
ROWS_PER_PRODUCT = 2048
QUESTIONS_PER_PRODUCT = 1024
QUESTION_BLOCK_BYTES = 16 << 20
OUTPUT_ROWS = 1 << 16
TASKS_PER_CORE = 4
SLACK = 1e-6


def _unit_rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Array column to a matrix of unit rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    matrix = np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    norms[norms == 0] = 1.0
    return matrix / norms


def _embedded(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.filter("embedding is not null").select(*columns, "embedding")


def _ids(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    values = column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()
    return values.astype("U") if values.dtype == object else values


def _slices(batch: pa.RecordBatch, rows: int = ROWS_PER_PRODUCT) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


class _Best:
    """The best ``limits[q]`` rows seen so far for each question ``q``.

    Products are taken over small blocks, and only rows that may still be among the best
    are rounded, sorted and kept, so what is held goes by the questions alone.
    """

    def __init__(self, questions: np.ndarray, limits: np.ndarray):
        self.questions = questions
        self.limits = limits
        self.worst = np.full(len(limits), np.inf)
        self.rows = None
        self.found = []
        self.n_found = 0

    def add(self, vectors: np.ndarray, ids: np.ndarray, asking: np.ndarray | None = None) -> None:
        """Take in chunks, for all questions or those numbered in ``asking``."""
        for start in range(0, len(ids), ROWS_PER_PRODUCT):
            block, block_ids = vectors[start:start + ROWS_PER_PRODUCT], ids[start:start + ROWS_PER_PRODUCT]
            count = len(self.limits) if asking is None else len(asking)
            for first in range(0, count, QUESTIONS_PER_PRODUCT):
                last = min(first + QUESTIONS_PER_PRODUCT, count)
                part = slice(first, last) if asking is None else asking[first:last]
                self._add_block(np.arange(first, last) if asking is None else part, part, block, block_ids)
            if self.n_found > len(self.limits):
                self._merge()

    def _add_block(self, numbers: np.ndarray, part, vectors: np.ndarray, ids: np.ndarray) -> None:
        cosine = self.questions[part] @ vectors.T
        bound = self.worst[part]
        keep = int(self.limits[part].max())
        if len(ids) > keep and np.isinf(bound).any():
            # Rows past the block's own k-th distance cannot be among the best.
            own = np.partition(np.where(np.isnan(cosine), -np.inf, cosine), len(ids) - keep, axis=1)[:, len(ids) - keep]
            bound = np.minimum(bound, np.maximum(np.round(1.0 - own, DECIMALS), 0.0))
        # A little more than rounding can make up; distances below decide.
        at = np.flatnonzero(cosine >= (1.0 - bound - 2 * 10.0 ** -DECIMALS)[:, None])
        question, column = np.divmod(at, len(ids))
        distance = np.maximum(np.round(1.0 - cosine.ravel()[at], DECIMALS), 0.0) + 0.0
        kept = distance <= bound[question]
        if kept.any():
            self.found.append((numbers[question[kept]], distance[kept], ids[column[kept]]))
            self.n_found += int(kept.sum())
            # Many equal rows, as of copies, are cut before more come.
            if self.n_found > 8 * len(self.limits) + (1 << 20):
                self._merge()

    def _merge(self) -> None:
        if not self.found:
            return
        parts = [self.rows, *self.found] if self.rows is not None else self.found
        found = tuple(np.concatenate(column) for column in zip(*parts))
        self.found, self.n_found = [], 0
        order = np.lexsort((found[2], found[1], found[0]))
        question, distance, ids = (part[order] for part in found)
        first = np.searchsorted(question, np.arange(len(self.limits)))
        rank = np.arange(len(question)) - first[question]
        kept = rank < self.limits[question]
        self.rows = (question[kept], distance[kept], ids[kept])
        full = rank == self.limits[question] - 1
        self.worst[question[full]] = distance[full]

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        self._merge()
        return self.rows


def _schema_of(questions: DataFrame, chunks: DataFrame) -> str:
    question_type = questions.schema["query_id"].dataType.simpleString()
    chunk_type = chunks.schema["chunk_id"].dataType.simpleString()
    return f"query_id {question_type}, top_k int, chunk_id {chunk_type}, distance double"


def _arrow_type(name: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[name]


def _output(best: _Best, question_ids: pa.Array, types: tuple[pa.DataType, pa.DataType]) -> Iterator[pa.RecordBatch]:
    rows = best.result()
    for start in range(0, 0 if rows is None else len(rows[0]), OUTPUT_ROWS):
        question, distance, ids = (part[start:start + OUTPUT_ROWS] for part in rows)
        yield pa.RecordBatch.from_pydict(
            {
                "query_id": question_ids.take(pa.array(question)).cast(types[0]),
                "top_k": pa.array(best.limits[question] // fixed.FETCH_FACTOR, pa.int32()),
                "chunk_id": pa.array(ids.tolist() if ids.dtype.kind == "U" else ids, types[1]),
                "distance": pa.array(distance, pa.float64()),
            }
        )


def _types(questions: DataFrame, chunks: DataFrame) -> tuple[pa.DataType, pa.DataType]:
    return (
        _arrow_type(questions.schema["query_id"].dataType.simpleString()),
        _arrow_type(chunks.schema["chunk_id"].dataType.simpleString()),
    )


def _ranked(candidates: DataFrame) -> DataFrame:
    """Final cut over the tasks' candidates; Spark cuts before and after the shuffle."""
    order = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    too_many = F.raise_error(F.lit(f"top_k above {fixed.TOP_K_MAX}")).cast("int")
    checked = candidates.withColumn(
        "top_k", F.when(F.col("top_k") > fixed.TOP_K_MAX, too_many).otherwise(F.col("top_k"))
    )
    return (
        checked.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= fixed.FETCH_FACTOR * fixed.TOP_K_MAX)
        .filter(F.col("rank") <= fixed.FETCH_FACTOR * F.col("top_k"))
    )


def small_question_set(
    questions: DataFrame,
    max_bytes: int = MAX_BROADCAST_BYTES,
    max_questions: int = MAX_BROADCAST_QUESTIONS,
) -> pa.Table | None:
    """The question rows if they are few enough to broadcast, else None.

    At most one row over the limit is fetched to find out.
    """
    head = _embedded(questions, "query_id", "top_k").limit(max_questions + 1).toArrow()
    # Vectors are widened to double before they are sent.
    return head if head.num_rows <= max_questions and 2 * head.nbytes <= max_bytes else None


def nearest_chunks(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """The ``2 * top_k`` nearest chunks of every question, ranked.

    ``questions``: query_id, embedding, top_k (1 to 10). ``chunks``: chunk_id,
    embedding. Gives query_id, top_k, chunk_id, distance, rank. The size of the
    question side decides between the two exact ways.
    """
    head = small_question_set(questions)
    if head is not None:
        return nearest_by_broadcast(questions, chunks, head)
    return nearest_by_cells(questions, chunks)


def nearest_by_broadcast(questions: DataFrame, chunks: DataFrame, head: pa.Table) -> DataFrame:
    """Exact search with the fetched question rows ``head`` sent to every task."""
    types = _types(questions, chunks)
    schema = _schema_of(questions, chunks)
    if head.num_rows == 0:
        return _ranked(questions.sparkSession.createDataFrame([], schema))
    sent = questions.sparkSession.sparkContext.broadcast(
        (
            _unit_rows(head.column("embedding")),
            head.column("query_id").combine_chunks(),
            np.array(head.column("top_k").to_pylist(), dtype=np.int64) * fixed.FETCH_FACTOR,
        )
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, question_ids, limits = sent.value
        best = _Best(vectors, limits)
        for batch in batches:
            for rows in _slices(batch):
                best.add(_unit_rows(rows.column("embedding")), _ids(rows.column("chunk_id")))
        yield from _output(best, question_ids, types)

    # Every task may emit a full set of candidates, so their number grows with the
    # tasks, not the rows. A few long tasks per core keep that shuffle small.
    tasks = TASKS_PER_CORE * questions.sparkSession.sparkContext.defaultParallelism
    candidates = _embedded(chunks, "chunk_id").coalesce(tasks).mapInArrow(search, schema)
    return _ranked(candidates)


def pick_pivots(chunks: DataFrame, cells: int) -> np.ndarray:
    """Vectors of ``cells`` chunks, chosen by hashed id: a bounded, repeatable pick."""
    picked = (
        _embedded(chunks, "chunk_id")
        .orderBy(F.xxhash64(F.col("chunk_id")), "chunk_id")
        .limit(cells)
        .select("embedding")
        .toArrow()
    )
    return _unit_rows(picked.column("embedding")) if picked.num_rows else np.zeros((0, 1))


def _chords(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Straight-line distances between unit vectors: a metric, unlike the cosine one."""
    return np.sqrt(np.maximum(2.0 - 2.0 * (vectors @ pivots.T), 0.0))


def assign_cells(chunks: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add the nearest pivot's number and the distance to it."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            chords = _chords(_unit_rows(batch.column("embedding")), pivots)
            cell = chords.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("chunk_id"),
                    batch.column("embedding"),
                    pa.array(cell, pa.int32()),
                    pa.array(chords[np.arange(len(cell)), cell], pa.float64()),
                ],
                names=["chunk_id", "embedding", "cell", "radius"],
            )

    rows = _embedded(chunks, "chunk_id")
    types = [f"{field.name} {field.dataType.simpleString()}" for field in rows.schema]
    return rows.mapInArrow(assign, ", ".join([*types, "cell int", "radius double"]))


def _visits(
    questions: DataFrame, pivots: np.ndarray, near: np.ndarray, far: np.ndarray, probes: int | None
) -> DataFrame:
    """Add ``cells``: the cells a question has to visit."""
    between = _chords(pivots, pivots)
    held = np.isfinite(near)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            chords = _chords(_unit_rows(batch.column("embedding")), pivots)
            if probes is None:
                limits = np.array(batch.column("top_k").to_pylist()) * fixed.FETCH_FACTOR
                chosen = _reachable(chords, limits, near, far, between) & held
                cells = [np.flatnonzero(row).tolist() for row in chosen]
            else:
                ranked = np.argsort(np.where(held, chords, np.inf), axis=1, kind="stable")
                cells = [row[:min(probes, int(held.sum()))].tolist() for row in ranked]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cells, pa.list_(pa.int32()))],
                names=[*batch.schema.names, "cells"],
            )

    rows = _embedded(questions, "query_id", "top_k")
    types = [f"{field.name} {field.dataType.simpleString()}" for field in rows.schema]
    return rows.mapInArrow(visit, ", ".join([*types, "cells array<int>"]))


def _reachable(
    chords: np.ndarray, limits: np.ndarray, near: np.ndarray, far: np.ndarray, between: np.ndarray
) -> np.ndarray:
    """Which cells can hold one of a question's best rows.

    The pivots are chunks themselves, so the k-th closest pivot is an upper bound
    for the k-th closest chunk. A cell's lower bound comes from the triangle
    inequality (its members lie between ``near`` and ``far`` of its pivot) and
    from the plane halfway to the question's own pivot.
    """
    ordered = np.sort(chords, axis=1)
    enough = limits <= chords.shape[1]
    upper = np.where(enough, ordered[np.arange(len(limits)), np.minimum(limits, chords.shape[1]) - 1], np.inf)
    ring = np.maximum(chords - far, near - chords)
    own = chords.argmin(axis=1)
    gap = between[own]
    halfway = np.divide(
        chords ** 2 - chords.min(axis=1)[:, None] ** 2, 2 * gap, out=np.zeros_like(chords), where=gap > 1e-9
    )
    return np.maximum(ring, halfway) <= upper[:, None] + SLACK


def nearest_by_cells(
    questions: DataFrame,
    chunks: DataFrame,
    cells: int = 64,
    probes: int | None = None,
    chunk_block_rows: int = 16384,
    question_block_rows: int = 16384,
) -> DataFrame:
    """Search by cells for any number of questions; exact unless ``probes`` is set."""
    types = _types(questions, chunks)
    schema = _schema_of(questions, chunks)
    pivots = pick_pivots(chunks, cells)
    if len(pivots) == 0:
        return _ranked(questions.sparkSession.createDataFrame([], schema))
    assigned = assign_cells(chunks, pivots)
    # One row per cell: bounded by the number of pivots.
    stats = assigned.groupBy("cell").agg(
        F.count("*").alias("n"), F.min("radius").alias("near"), F.max("radius").alias("far")
    ).toArrow().to_pylist()
    near, far = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
    for row in stats:
        near[row["cell"]], far[row["cell"]] = row["near"], row["far"]
    # Wide vectors make smaller blocks of questions.
    block_rows = min(question_block_rows, max(QUESTIONS_PER_PRODUCT, QUESTION_BLOCK_BYTES // (8 * pivots.shape[1])))
    question_blocks = max(1, -(-questions.count() // block_rows))
    # A share of the chunks is read as it comes, whatever its size: more shares only give
    # all cores work where there are few blocks of questions.
    cores = questions.sparkSession.sparkContext.defaultParallelism
    held_blocks = -(-sum(row["n"] for row in stats) // chunk_block_rows)
    shares = max(1, min(held_blocks, -(-TASKS_PER_CORE * cores // question_blocks)))
    n_tasks = question_blocks * shares

    asked = _visits(questions, pivots, near, far, probes).select(
        F.pmod(F.xxhash64("query_id"), F.lit(question_blocks)).alias("question_block"),
        F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"),
        F.lit(None).cast("int").alias("cell"), "query_id", "top_k", "cells",
        F.lit(None).cast(chunks.schema["chunk_id"].dataType).alias("chunk_id"), "embedding",
    )
    held = assigned.select(
        F.explode(F.sequence(F.lit(0), F.lit(question_blocks - 1))).alias("question_block"),
        F.pmod(F.xxhash64("chunk_id"), F.lit(shares)).alias("share"),
        "cell", F.lit(None).cast(questions.schema["query_id"].dataType).alias("query_id"),
        F.lit(None).cast("int").alias("top_k"), F.lit(None).cast("array<int>").alias("cells"), "chunk_id", "embedding",
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The task's questions, which are those without a cell and come first, against its chunks."""
        questions, best, asking = [], None, {}
        for batch in batches:
            n_asked = batch.column("cell").null_count
            if n_asked:
                questions.append(batch.slice(0, n_asked))
            batch = batch.slice(n_asked)
            if not batch.num_rows or not questions:
                continue
            if best is None:
                table = pa.Table.from_batches(questions).combine_chunks()
                limits = np.array(table.column("top_k").to_pylist(), dtype=np.int64) * fixed.FETCH_FACTOR
                best = _Best(_unit_rows(table.column("embedding")), limits)
                visits = table.column("cells").combine_chunks()
                visitor, visited = pc.list_parent_indices(visits).to_numpy(), visits.flatten().to_numpy()
                ids = table.column("query_id").combine_chunks()
                questions = [batch.slice(0, 0)]
                table = visits = None
            for rows in _slices(batch):
                cells = rows.column("cell").to_numpy()
                begins = np.flatnonzero(np.diff(cells, prepend=-1))
                vectors, held_ids = _unit_rows(rows.column("embedding")), _ids(rows.column("chunk_id"))
                for begin, end in zip(begins, np.append(begins[1:], len(cells))):
                    if cells[begin] not in asking:
                        # Cells come in order, so one cell's questions are enough to remember.
                        asking = {cells[begin]: np.sort(visitor[visited == cells[begin]])}
                    who = asking[cells[begin]]
                    if len(who):
                        best.add(vectors[begin:end], held_ids[begin:end], None if len(who) == len(ids) else who)
        if best is not None:
            yield from _output(best, ids, types)

    task = (F.col("question_block") * shares + F.col("share")).cast("int")
    candidates = (
        asked.unionByName(held)
        .repartitionById(n_tasks, task)
        .sortWithinPartitions(F.asc_nulls_first("cell"))
        .drop("question_block", "share")
        .mapInArrow(search, schema)
    )
    return _ranked(candidates)


def nearest_in_probed_cells(
    questions: DataFrame, chunks: DataFrame, cells: int = 64, probes: int = 16, **sizes: int
) -> DataFrame:
    """Approximate search: only the ``probes`` closest cells of each question."""
    return nearest_by_cells(questions, chunks, cells=cells, probes=probes, **sizes)


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact top-k rows that the approximate search also found."""
    wanted = exact.filter("rank <= top_k").select("query_id", "chunk_id")
    found = approximate.select("query_id", "chunk_id", F.lit(1).alias("hit"))
    return wanted.join(found, ["query_id", "chunk_id"], "left").agg(
        F.count("*").alias("wanted"),
        F.count("hit").alias("found"),
        (F.count("hit") / F.count("*")).alias("recall"),
    )
