"""Page rows to chunk rows."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citemill.functions import fixed_values as fixed
from citemill.functions.text import chunk_hash, chunk_id, clean_page_text, found_header
from citemill.operators.running import running_values

SPLIT_ROWS = 256


def _cut_points(text: str, start: int, end: int, separator: str) -> Sequence[int]:
    """Piece boundaries of text[start:end]; a separator opens the piece after it."""
    if not separator:
        return range(start, end + 1)
    cuts = [start]
    at = text.find(separator, start, end)
    while at >= 0:
        if at > start:
            cuts.append(at)
        at = text.find(separator, at + len(separator), end)
    cuts.append(end)
    return cuts


def _merged(text: str, cuts: Sequence[int], size: int, overlap: int) -> list[str]:
    """Greedy chunks over adjacent pieces, found by bisection on their boundaries."""
    chunks: list[str] = []
    first, final = 0, len(cuts) - 1
    while True:
        stop = min(bisect_right(cuts, cuts[first] + size) - 1, final)
        body = text[cuts[first]:cuts[stop]].strip()
        if body:
            chunks.append(body)
        if stop == final:
            return chunks
        # Keep at most `overlap` characters, and leave room for the next piece.
        keep_from = max(cuts[stop] - overlap, cuts[stop + 1] - size)
        first = min(max(first, bisect_left(cuts, keep_from)), stop)


def split_text(
    text: str,
    size: int = fixed.CHUNK_SIZE,
    overlap: int = fixed.CHUNK_OVERLAP,
    separators: tuple[str, ...] = fixed.SEPARATORS,
) -> list[str]:
    """Overlapping chunks of at most ``size`` characters, cut at the widest separator.

    The separators must end with the empty one, which cuts anywhere.
    """
    return _split_range(text, 0, len(text), size, overlap, separators)


def _split_range(
    text: str, start: int, end: int, size: int, overlap: int, separators: tuple[str, ...]
) -> list[str]:
    chunks: list[str] = []
    if start == end:
        return chunks
    level = 0
    while separators[level] and text.find(separators[level], start, end) < 0:
        level += 1
    cuts = _cut_points(text, start, end, separators[level])
    if not separators[level] and size > 1:
        # Single characters are never oversized, so they are one run without going through them.
        return _merged(text, cuts, size, overlap)
    run = [start]
    for low, high in zip(cuts, cuts[1:]):
        if high - low < size:
            run.append(high)
            continue
        # An oversized piece closes the run before it and is cut further.
        if len(run) > 1:
            chunks.extend(_merged(text, run, size, overlap))
        chunks.extend(_split_range(text, low, high, size, overlap, separators[level + 1:]))
        run = [high]
    if len(run) > 1:
        chunks.extend(_merged(text, run, size, overlap))
    return chunks


def split_batches(batches: Iterator[pa.Array], size: int, overlap: int) -> Iterator[pa.Array]:
    """Chunk arrays of batches of texts, a few rows at a time as Python objects.

    So what a worker holds does not grow with the rows Spark puts into a batch.
    """
    for texts in batches:
        # An empty batch is answered too.
        for start in range(0, max(len(texts), 1), SPLIT_ROWS):
            rows = texts.slice(start, SPLIT_ROWS).to_pylist()
            pieces = [split_text(value, size, overlap) if value else [] for value in rows]
            yield pa.array(pieces, pa.list_(pa.string()))


def split_chunks(
    text: Column, size: int = fixed.CHUNK_SIZE, overlap: int = fixed.CHUNK_OVERLAP
) -> Column:
    """Array of chunks of a text column."""

    @F.arrow_udf("array<string>")
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return split_batches(batches, size, overlap)

    return split(text)


def clean_pages(pages: DataFrame, keep_empty: bool = False) -> DataFrame:
    """Cleaned pages; those left empty are dropped unless ``keep_empty``."""
    cleaned = clean_page_text(F.coalesce("raw_text", F.lit("")))
    kept = [name for name in pages.columns if name != "raw_text"]
    if keep_empty:
        return pages.select(*kept, cleaned.alias("text"))
    # As a filter the clean-up would run twice per page, in the filter and after it.
    return pages.select(*kept, F.explode(F.filter(F.array(cleaned), lambda text: text != "")).alias("text"))


def carry_section(
    pages: DataFrame, initial: str = fixed.SECTION_INITIAL, block_rows: int = 1024
) -> DataFrame:
    """Give every cleaned page its own header or the last one before it."""
    own = pages.withColumn("__header", found_header(F.col("text")))
    carried = running_values(
        own, ["document_name"], "page", last={"section": "__header"},
        block_rows=block_rows,
    )
    return carried.withColumn("section", F.coalesce("section", F.lit(initial))).drop("__header")


def split_pages(pages: DataFrame) -> DataFrame:
    """Cleaned pages with their own header (or null), chunk array and its size."""
    return (
        pages.withColumn("__header", found_header(F.col("text")))
        .withColumn("__chunks", split_chunks(F.col("text")))
        .drop("text")
        .withColumn("__n", F.size("__chunks"))
    )


def number_chunks(
    pages: DataFrame, initial: str = fixed.SECTION_INITIAL, block_rows: int = 1024, tasks: int | None = None
) -> DataFrame:
    """Chunk rows with section, running index over the document, hash and id.

    ``pages`` come from :func:`split_pages`. Numbers are worked out per page,
    so the window sorts pages, not chunks. ``tasks`` as for :func:`running_values`.
    """
    running = running_values(
        pages,
        ["document_name"],
        "page",
        last={"section": "__header"},
        totals={"__first": "__n"},
        block_rows=block_rows,
        tasks=tasks,
    )
    exploded = running.select(
        "document_name",
        "file_path",
        "page",
        "total_pages",
        F.coalesce("section", F.lit(initial)).alias("section"),
        "__first",
        F.posexplode_outer("__chunks").alias("index_in_page", "text"),
    )
    # An inner explode would make Spark filter on the array's size first, and for
    # that run the splitter a second time.
    return (
        exploded.filter("text is not null")
        .withColumn("chunk_index", F.col("__first") + F.col("index_in_page"))
        .withColumn("chunk_hash", chunk_hash(F.col("text")))
        .withColumn(
            "chunk_id",
            chunk_id(F.col("document_name"), F.col("page"), F.col("index_in_page"), F.col("chunk_hash")),
        )
        .select(
            "chunk_id", "document_name", "file_path", "page", "total_pages",
            "section", "chunk_index", "index_in_page", "chunk_hash", "text",
        )
    )


def chunk_pages(pages: DataFrame, block_rows: int = 1024) -> DataFrame:
    """Raw page rows to chunk rows in one lazy plan."""
    return number_chunks(split_pages(clean_pages(pages)), block_rows=block_rows)
