"""Expressions over questions, citations and answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citemill.functions import fixed_values as fixed
from citemill.functions.text import snippet, strip


def rejection_reason(query: Column, top_k: Column) -> Column:
    """Why a question is refused, or null for a valid one."""
    return (
        F.when(query.isNull() | (strip(query) == ""), "blank query")
        .when(~effective_top_k(top_k).between(fixed.TOP_K_MIN, fixed.TOP_K_MAX), "top_k out of range")
    )


def effective_top_k(top_k: Column) -> Column:
    return F.coalesce(top_k.cast("int"), F.lit(fixed.TOP_K_DEFAULT))


def cache_key(query: Column, top_k: Column) -> Column:
    """Key under which the answer to a question is kept."""
    return F.sha2(F.concat_ws("_", F.lower(strip(query)), top_k.cast("string")), 256)


def citation(
    index: Column, document: Column, page: Column, section: Column, text: Column, distance: Column
) -> Column:
    return F.struct(
        index.cast("int").alias("index"),
        F.coalesce(document, F.lit(fixed.DOCUMENT_DEFAULT)).alias("document"),
        F.coalesce(page.cast("int"), F.lit(fixed.PAGE_DEFAULT)).alias("page"),
        F.coalesce(section, F.lit(fixed.SECTION_DEFAULT)).alias("section"),
        snippet(text).alias("snippet"),
        F.round(distance, fixed.DISTANCE_DECIMALS).alias("distance"),
    )


def context_block(
    index: Column, document: Column, page: Column, section: Column, text: Column
) -> Column:
    return F.format_string(
        fixed.CONTEXT_BLOCK,
        index.cast("int"),
        F.coalesce(document, F.lit(fixed.DOCUMENT_DEFAULT)),
        F.coalesce(section, F.lit(fixed.SECTION_DEFAULT)),
        F.coalesce(page.cast("int"), F.lit(fixed.PAGE_DEFAULT)),
        text,
    )


def user_prompt(context: Column, query: Column) -> Column:
    return F.concat(
        F.lit(fixed.PROMPT_HEAD), context,
        F.lit(fixed.PROMPT_QUESTION), query,
        F.lit(fixed.PROMPT_TAIL),
    )


def guard_answer(total_chunks: Column, context_count: Column) -> Column:
    """The canned answer when nothing can be cited, else null."""
    return F.when(total_chunks == 0, fixed.ANSWER_EMPTY_INDEX).when(
        context_count == 0, fixed.ANSWER_NO_CONTEXT
    )


def superscript(text: Column) -> Column:
    return F.regexp_replace(text, fixed.CITATION_MARK, fixed.CITATION_SUPERSCRIPT)


def answer_cleanup(answer: Column) -> Column:
    """Cut the model's own reference list, then mark citations."""
    body = F.get(F.split(answer, fixed.REFERENCES_TAIL, 2), F.lit(0))
    return superscript(strip(body))


def failure_answer(error: Column, answer: Column) -> Column:
    return F.when(error.isNotNull(), F.concat(F.lit(fixed.ANSWER_FAILURE), error)).otherwise(answer)


def citation_label(index: Column, document: Column, section: Column, page: Column) -> Column:
    """``[i] document › section › Page n``; an absent or empty part is left out."""
    return F.concat(
        F.lit("["), index.cast("string"), F.lit("] "),
        F.coalesce(document, F.lit("Document")),
        F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit(" › "), section)).otherwise(""),
        F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(F.lit(" › Page "), page.cast("string"))).otherwise(""),
    )


def public_citations(citations: Column) -> Column:
    """Citations as an API caller sees them, without the index."""
    return F.transform(
        citations,
        lambda c: F.struct(
            c["document"].alias("document"),
            c["page"].alias("page"),
            c["section"].alias("section"),
            c["snippet"].alias("snippet"),
            c["distance"].alias("distance"),
        ),
    )


def response_seconds(start: Column, end: Column) -> Column:
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return micros / F.lit(1_000_000.0)


def response_time_label(seconds: Column) -> Column:
    return F.format_string("%.2fs", seconds)
