"""Page cleaning, sections, hashes, snippets."""

from __future__ import annotations

from pyspark.sql import functions as F

from citemill.functions import text as tx
from citemill.operators.chunking import carry_section, clean_pages
from citemill.registry import inputs as given
from citemill.registry.catalog import register
from citemill.sources.files import pages_from_arrays


@register(
    "s9_page_scan",
    given.with_ctes(
        "SELECT document_name, file_path, page, total_pages, raw_text FROM sop_pages",
        given.SOP_PAGES,
    ),
)
def s9(spark, folder):
    return pages_from_arrays(given.sop_documents(spark, folder))


@register(
    "p1_clean_page_text",
    given.with_ctes("SELECT document_name, page, text FROM clean_pages", given.SOP_PAGES, given.CLEAN_PAGES),
)
def p1(spark, folder):
    return given.sop_pages(spark, folder).select(
        "document_name", "page", tx.clean_page_text(F.col("raw_text")).alias("text")
    )


@register(
    "p2_drop_empty_pages",
    given.with_ctes(
        "SELECT document_name, page, total_pages FROM clean_pages WHERE length(text) > 0",
        given.SOP_PAGES, given.CLEAN_PAGES,
    ),
)
def p2(spark, folder):
    return clean_pages(given.sop_pages(spark, folder)).select("document_name", "page", "total_pages")


@register(
    "p3_section_header",
    given.with_ctes(
        "SELECT document_name, page, coalesce(header, 'General Section') AS section FROM found_headers",
        given.SOP_PAGES, given.CLEAN_PAGES, given.FOUND_HEADERS,
    ),
)
def p3(spark, folder):
    return clean_pages(given.sop_pages(spark, folder)).select(
        "document_name", "page", tx.section_header(F.col("text")).alias("section")
    )


LINES_SQL = r"""SELECT document_name, page,
    list_filter(list_transform(string_split(text, chr(10)),
                lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13))), lambda x: x <> '')[1:5] AS lines
  FROM clean_pages WHERE length(text) > 0"""


@register(
    "k3_first_lines",
    given.with_ctes(
        f"SELECT document_name, page, array_to_string(lines, chr(10)) AS first_lines FROM ({LINES_SQL})",
        given.SOP_PAGES, given.CLEAN_PAGES,
    ),
)
def k3(spark, folder):
    return clean_pages(given.sop_pages(spark, folder)).select(
        "document_name", "page", F.array_join(tx.first_lines(F.col("text")), "\n").alias("first_lines")
    )


@register(
    "w1_carry_section",
    given.with_ctes(
        """SELECT document_name, page,
             coalesce(last_value(header IGNORE NULLS) OVER (PARTITION BY document_name ORDER BY page
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'General Overview') AS section
           FROM found_headers""",
        given.SOP_PAGES, given.CLEAN_PAGES, given.FOUND_HEADERS,
    ),
)
def w1(spark, folder):
    return carry_section(clean_pages(given.sop_pages(spark, folder))).select("document_name", "page", "section")


@register(
    "p4_embedding_text",
    """SELECT doc_id, CASE WHEN t = '' THEN 'empty' ELSE t END AS embedding_text
       FROM (SELECT doc_id, trim(replace(replace(text, chr(13) || chr(10), ' '), chr(10), ' '),
                                 ' ' || chr(9) || chr(13)) AS t FROM documents)""",
)
def p4(spark, folder):
    return given.spread_documents(spark, folder).select(
        "doc_id", tx.embedding_text(F.col("text")).alias("embedding_text")
    )


@register(
    "p5_chunk_hash",
    "SELECT doc_id, substr(sha256(text), 1, 12) AS chunk_hash FROM documents",
)
def p5(spark, folder):
    return given.spread_documents(spark, folder).select("doc_id", tx.chunk_hash(F.col("text")).alias("chunk_hash"))


@register(
    "p9_snippet",
    r"""SELECT doc_id, CASE WHEN length(flat) > 240 THEN substr(flat, 1, 240) || '...' ELSE flat END AS snippet
        FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM documents)""",
)
def p9(spark, folder):
    return given.spread_documents(spark, folder).select("doc_id", tx.snippet(F.col("text")).alias("snippet"))


@register(
    "d2_duplicate_chunks",
    """SELECT substr(sha256(text), 1, 12) AS chunk_hash, count(*) AS copies FROM documents
       GROUP BY 1 HAVING count(*) > 1""",
)
def d2(spark, folder):
    from citemill.operators.catalog import duplicate_chunks

    return duplicate_chunks(
        given.spread_documents(spark, folder).select(tx.chunk_hash(F.col("text")).alias("chunk_hash"))
    )
