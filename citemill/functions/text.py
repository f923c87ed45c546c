"""Text expressions used while pages are cleaned, sectioned and hashed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citemill.functions import fixed_values as fixed


def strip(text: Column) -> Column:
    """Remove Unicode whitespace at both ends (``trim`` only knows the space)."""
    return F.btrim(text, F.lit(fixed.WHITESPACE))


def clean_page_text(text: Column) -> Column:
    """Drop page boilerplate, squeeze blank lines, strip.

    Patterns that ignore case are slow, so pages that cannot match any are only stripped.
    """
    without_approval = F.regexp_replace(text, fixed.APPROVAL_LINE, "")
    without_title = F.regexp_replace(without_approval, fixed.MANUAL_TITLE, "")
    cleaned = F.regexp_replace(without_title, fixed.BLANK_LINE_RUN, "\n\n")
    lower = F.lower(text)
    may_match = (
        lower.contains(fixed.APPROVAL_PART) | lower.contains(fixed.MANUAL_PART) | text.contains("\n\n\n")
    )
    return strip(F.when(may_match, cleaned).otherwise(text))


def first_lines(text: Column, count: int = fixed.HEADER_LINES) -> Column:
    """The first non-blank lines, stripped."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda line: line != "")
    return F.slice(lines, 1, count)


def found_header(text: Column) -> Column:
    """The header among the first five non-blank lines, or null."""
    headers = F.filter(
        first_lines(text),
        lambda line: line.rlike(fixed.SECTION_HEADER)
        & (F.length(line) >= fixed.HEADER_MIN_LENGTH)
        & ~F.lower(line).startswith(fixed.PAGE_WORD),
    )
    return F.substring(F.get(headers, F.lit(0)), 1, fixed.HEADER_MAX_LENGTH)


def section_header(text: Column, fallback: str | Column = fixed.SECTION_FALLBACK) -> Column:
    """The page's own header, or ``fallback``."""
    other = fallback if isinstance(fallback, Column) else F.lit(fallback)
    return F.coalesce(found_header(text), other)


def embedding_text(text: Column) -> Column:
    """One-line form of a text, never empty, as handed to an embedder."""
    one_line = F.replace(F.replace(text, F.lit("\r\n"), F.lit(" ")), F.lit("\n"), F.lit(" "))
    # Unlike two branches of a condition, nullif works the text out once.
    return F.when(text.isNotNull(), F.coalesce(F.nullif(strip(one_line), F.lit("")), F.lit(fixed.EMPTY_TEXT)))


def chunk_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, fixed.CHUNK_HASH_LENGTH)


def chunk_id(document: Column, page: Column, index_in_page: Column, digest: Column) -> Column:
    return F.concat(
        document,
        F.lit("_p"), page.cast("string"),
        F.lit("_c"), index_in_page.cast("string"),
        F.lit("_"), digest,
    )


def collapse_whitespace(text: Column) -> Column:
    """Words joined by single spaces."""
    return F.trim(F.regexp_replace(text, rf"(?U)[{fixed.WS_CLASS}]+", " "))


def snippet(text: Column) -> Column:
    flat = collapse_whitespace(text)
    return F.when(
        F.length(flat) > fixed.SNIPPET_LENGTH,
        F.concat(F.substring(flat, 1, fixed.SNIPPET_LENGTH), F.lit(fixed.SNIPPET_TAIL)),
    ).otherwise(flat)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)
