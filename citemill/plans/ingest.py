"""From changed files to live chunks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citemill.functions import fixed_values as fixed
from citemill.functions.text import base_name
from citemill.operators.catalog import ingest_receipts
from citemill.operators.chunking import clean_pages, number_chunks, split_pages
from citemill.operators.vectors import Embedder, embed, hashed_word_embedder
from citemill.session import delete_on_exit, scratch_path
from citemill.sources.files import changed_files, is_valid_pdf
from citemill.sources.store import ChunkStore

#: Pages that a task numbers, embeds and writes, about 15,000 chunks with their vectors.
PAGES_PER_TASK = 4096


@dataclass
class ScanOutcome:
    """What a scan did: receipts of the documents taken in, and the files that failed.

    ``version`` is the publish it made, None without one.
    """

    dispatched: int
    synchronized: int
    status: str
    receipts: DataFrame | None = None
    failures: DataFrame | None = None
    version: int | None = None


def ingest_pages(
    store: ChunkStore,
    pages: DataFrame,
    version: int | None = None,
    embedder: Embedder = hashed_word_embedder,
) -> tuple[DataFrame, DataFrame, int]:
    """Split, number, embed and publish the pages; returns receipts, failures and the version.

    Every document with a row in ``pages`` is replaced, also one without chunks.
    A row with an ``error`` stands for a file that could not be read: its
    document stays as it was.

    Split pages are staged in the shared folder first, so pages are read and
    split once. The carried sections, chunk numbers and receipts then need only
    the staged table's slim columns. Receipts count the rows this publish wrote, so
    the cost is that of the pages, whatever the store holds.
    """
    if "error" not in pages.columns:
        pages = pages.withColumn("error", F.lit(None).cast("string"))
    staged_path = scratch_path(store.spark, "split-pages")
    split_pages(clean_pages(pages, keep_empty=True)).write.parquet(staged_path)
    staged = store.spark.read.parquet(delete_on_exit(store.spark, staged_path))
    good = staged.filter("error is null")
    with_text = good.filter("page is not null")
    chunks = number_chunks(with_text, tasks=with_text.count() // PAGES_PER_TASK + 1)
    version = store.publish(embed(chunks, embedder=embedder), good, version)
    failures = staged.filter("error is not null").select("document_name", "file_path", "error")
    return ingest_receipts(good, store.version_rows(version)), failures, version


def scan_and_ingest(
    store: ChunkStore,
    files: DataFrame,
    read_pages: Callable[[DataFrame], DataFrame],
    force_all: bool = False,
    manual: bool = False,
    embedder: Embedder = hashed_word_embedder,
    healthy: Callable[[], bool] = lambda: True,
) -> ScanOutcome:
    """One scan: valid files, the changed ones (or all), their pages, publish, manifest.

    ``files`` is a listing (absolute_path, length, modified_ms), ``read_pages``
    turns the chosen listing rows into page rows. The manifest is written after
    the publish, so files of a failed run are taken again by the next. A scan that
    is repeated after its manifest was written finds nothing changed, whoever
    started it, so manual and polled scans share a store.

    Where ``healthy`` says that pages or vectors cannot be made now, nothing is
    touched and the scan is deferred (aborted, if manual).
    """
    if not healthy():
        return ScanOutcome(0, 0, fixed.STATUS_MANUAL_ABORTED if manual else fixed.STATUS_DEFERRED)
    valid = files.filter(is_valid_pdf(F.col("absolute_path"), F.col("length")))
    chosen = valid if force_all else changed_files(valid, store.manifest())
    # The listing may differ when it is read again, so the choice is kept.
    chosen_path = scratch_path(store.spark, "chosen-files")
    chosen.write.parquet(chosen_path)
    delete_on_exit(store.spark, chosen_path)
    chosen = store.spark.read.schema(files.select(*chosen.columns).schema).parquet(chosen_path)
    dispatched = chosen.count()
    if dispatched == 0:
        return ScanOutcome(0, 0, fixed.STATUS_MANUAL_DONE % (0, 0) if manual else fixed.STATUS_UP_TO_DATE)
    receipts, failures, version = ingest_pages(store, read_pages(chosen), embedder=embedder)
    # Files that failed, or went missing meanwhile, are left for the next scan.
    taken = chosen.withColumn("document_name", base_name(F.col("absolute_path"))).join(
        receipts.select("document_name"), "document_name", "left_semi"
    )
    noted = store.write_manifest(taken)
    synchronized = store.manifest_log.sizes([noted]).get(noted, 0)
    message = fixed.STATUS_MANUAL_DONE if manual else fixed.STATUS_DONE
    return ScanOutcome(dispatched, synchronized, message % (synchronized, dispatched), receipts, failures, version)
