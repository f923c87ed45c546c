"""From ranked candidates to citations, context and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citemill.functions import fixed_values as fixed
from citemill.functions.answers import (
    cache_key,
    citation,
    context_block,
    effective_top_k,
    guard_answer,
    rejection_reason,
    user_prompt,
)
from citemill.functions.text import strip


def validate_questions(questions: DataFrame) -> DataFrame:
    """Add ``reason``: null for a valid question, with query stripped and top_k filled."""
    return questions.withColumns(
        {
            "reason": rejection_reason(F.col("query"), F.col("top_k")),
            "query": strip(F.col("query")),
            "top_k": effective_top_k(F.col("top_k")),
        }
    )


def valid_questions(questions: DataFrame) -> DataFrame:
    return validate_questions(questions).filter("reason is null").drop("reason")


def with_cache_key(questions: DataFrame) -> DataFrame:
    return questions.withColumn("cache_key", cache_key(F.col("query"), F.col("top_k")))


def within_distance(
    candidates: DataFrame, mode: str = "strict", threshold: float = fixed.DISTANCE_THRESHOLD
) -> DataFrame:
    """Distance rule over ranked candidates.

    ``strict`` keeps distances up to the threshold. ``observed`` drops a far row
    only once ``top_k`` rows are taken, which the top_k cut does anyway.
    """
    if mode == "strict":
        return candidates.filter(F.col("distance") <= threshold)
    if mode == "observed":
        return candidates.filter((F.col("distance") <= threshold) | (F.col("rank") <= F.col("top_k")))
    raise ValueError(f"unknown distance mode: {mode}")


def top_k_cut(candidates: DataFrame) -> DataFrame:
    """Each question's own first top_k candidates.

    A distance limit keeps the front of a ranking, so ranks need no renumbering.
    """
    return candidates.filter(F.col("rank") <= F.col("top_k"))


def retrieved_rows(candidates: DataFrame, chunks: DataFrame, bounded: bool = False) -> DataFrame:
    """Candidates with the metadata and text of their chunks.

    Text joins only now, for the few rows that are cited. ``bounded`` says the
    candidates come from a question set that was checked to be small; they then
    go to the chunk scan, whose texts stay where they are.
    """
    details = chunks.select("chunk_id", "document_name", "page", "section", "text")
    return details.join(F.broadcast(candidates) if bounded else candidates, "chunk_id")


def cited_rows(retrieved: DataFrame) -> DataFrame:
    """One row per cited chunk with its citation and context block."""
    parts = [F.col("document_name"), F.col("page"), F.col("section"), F.col("text")]
    return retrieved.select(
        "query_id",
        "rank",
        citation(F.col("rank"), *parts, F.col("distance")).alias("citation"),
        context_block(F.col("rank"), *parts).alias("block"),
    )


def collect_context(cited: DataFrame) -> DataFrame:
    """Per question: ordered citations, their number, and the joined context.

    A question has at most ten rows here, so the collected lists are bounded. Citations
    and blocks are collected apart, so whoever needs no context moves no texts.
    """
    return cited.groupBy("query_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "citation"))), lambda row: row["citation"]
        ).alias("citations"),
        F.count("*").cast("int").alias("context_count"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", "citation", "block"))), lambda row: row["block"]
            ),
            "\n",
        ).alias("context"),
    )


def prompts(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """Prompt table for a batch inference job: only questions that have context."""
    return questions.select("query_id", "query").join(contexts, "query_id").select(
        "query_id",
        F.lit(fixed.SYSTEM_INSTRUCTION).alias("system_prompt"),
        user_prompt(F.col("context"), F.col("query")).alias("user_prompt"),
        "context_count",
    )


def guarded_answers(questions: DataFrame, contexts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every question with its context count and, where nothing is cited, the canned answer."""
    total = chunks.select(F.count("*").alias("n")).scalar()
    return (
        questions.select("query_id")
        .join(contexts.select("query_id", "context_count"), "query_id", "left")
        .select("query_id", F.coalesce("context_count", F.lit(0)).alias("context_count"))
        .withColumn("answer", guard_answer(total, F.col("context_count")))
    )
