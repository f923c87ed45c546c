"""Folder polling: every tick lists the files and takes in what changed.

Spark's file source never emits a changed file again, so the stream is one of
ticks. Each tick's batch lists the folder, compares it with the manifest and
publishes. A query never overlaps itself, and a repeated batch finds its own files
in the manifest, so retries after a lost driver do no harm. Batch numbers decide
nothing: manual scans may come in between, and a checkpoint may be new.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from citemill.functions import fixed_values as fixed
from citemill.operators.vectors import Embedder, hashed_word_embedder
from citemill.plans.ingest import ScanOutcome, scan_and_ingest
from citemill.sources.store import ChunkStore


def tick_stream(spark: SparkSession) -> DataFrame:
    """One row per micro-batch."""
    return spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()


def start_watching(
    store: ChunkStore,
    changes: DataFrame,
    read_pages: Callable[[DataFrame], DataFrame],
    checkpoint: str,
    trigger: dict | None = None,
    embedder: Embedder = hashed_word_embedder,
    on_scan: Callable[[int, ScanOutcome], None] | None = None,
) -> StreamingQuery:
    """Take in a stream of changed files, such as ``folder_stream.stream_listing``.

    A micro-batch holds the files that changed and no others, and those that the store's
    manifest knows as they are, after a restart, are left out. A scan that fails stops
    the query, and the next start gets the same files again; files that could not be
    read come again when they change.
    """

    def scan(listing: DataFrame, batch: int) -> None:
        outcome = scan_and_ingest(store, listing, read_pages, embedder=embedder)
        if on_scan:
            on_scan(batch, outcome)

    return (
        changes.writeStream.foreachBatch(scan)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "60 seconds"}))
        .start()
    )


def start_polling(
    store: ChunkStore,
    list_files: Callable[[], DataFrame],
    read_pages: Callable[[DataFrame], DataFrame],
    checkpoint: str,
    trigger: dict | None = None,
    embedder: Embedder = hashed_word_embedder,
    on_scan: Callable[[int, ScanOutcome], None] | None = None,
    healthy: Callable[[], bool] = lambda: True,
) -> StreamingQuery:
    """Start the polling query; ``on_scan`` is told each batch's number and outcome.

    A scan that fails is told as an outcome whose status says why, and the next tick
    tries again; so is one that ``healthy`` defers.

    The default trigger is every 60 seconds; ``{"availableNow": True}`` runs one tick.
    """

    def scan(_: DataFrame, batch: int) -> None:
        try:
            outcome = scan_and_ingest(store, list_files(), read_pages, embedder=embedder, healthy=healthy)
        except Exception as problem:  # a tick that fails leaves the store as it was
            if on_scan is None:
                raise
            outcome = ScanOutcome(0, 0, fixed.STATUS_ERROR % problem)
        if on_scan:
            on_scan(batch, outcome)

    return (
        tick_stream(store.spark)
        .writeStream.foreachBatch(scan)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "60 seconds"}))
        .start()
    )
