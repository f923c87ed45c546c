"""Summaries over the chunk table and replacement of a document's chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citemill.functions import fixed_values as fixed


def document_catalog(chunks: DataFrame) -> DataFrame:
    """One row per document: path and page total of its first chunk, chunk count."""
    return chunks.groupBy(
        F.coalesce("document_name", F.lit(fixed.CATALOG_DEFAULT)).alias("document_name")
    ).agg(
        F.coalesce(F.min_by("file_path", "chunk_index"), F.lit("")).alias("file_path"),
        F.coalesce(F.min_by("total_pages", "chunk_index"), F.lit(0)).alias("total_pages"),
        F.count("*").alias("chunk_count"),
    )


def chunk_count(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("total_chunks"))


def ingest_receipts(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Receipt per document of ``pages``, also for one that gave no chunk."""
    processed = pages.groupBy("document_name").agg(F.max("total_pages").alias("total_pages"))
    indexed = chunks.groupBy("document_name").agg(F.count("*").alias("chunks_indexed"))
    return processed.join(indexed, "document_name", "left").select(
        F.lit("success").alias("status"),
        "document_name",
        "total_pages",
        F.coalesce("chunks_indexed", F.lit(0)).alias("chunks_indexed"),
    )


def replace_documents(existing: DataFrame, processed: DataFrame, new: DataFrame) -> DataFrame:
    """Drop all rows of the ``processed`` documents, then add their new rows.

    ``processed`` lists every document that was read, so one whose new form has
    no chunks loses its old ones.
    """
    names = processed.select("document_name").distinct()
    return existing.join(names, "document_name", "left_anti").select(*existing.columns).unionByName(new)


def lookup_document(chunks: DataFrame, document_name: str) -> DataFrame:
    """Rows of one document; on a Parquet scan the filter is pushed down."""
    return chunks.filter(F.col("document_name") == document_name)


def duplicate_chunks(chunks: DataFrame) -> DataFrame:
    """Chunk hashes held more than once. Counting combines before the shuffle."""
    return chunks.groupBy("chunk_hash").agg(F.count("*").alias("copies")).filter("copies > 1")
