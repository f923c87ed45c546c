"""From a batch of questions to cited context and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citemill.functions import fixed_values as fixed
from citemill.operators.knn import nearest_by_broadcast, nearest_by_cells, small_question_set
from citemill.operators.retrieval import (
    cited_rows,
    collect_context,
    retrieved_rows,
    top_k_cut,
    valid_questions,
    with_cache_key,
    within_distance,
)
from citemill.operators.vectors import Embedder, embed, hashed_word_embedder


def cited_chunks(
    questions: DataFrame, chunks: DataFrame, mode: str = "strict", threshold: float = fixed.DISTANCE_THRESHOLD
) -> DataFrame:
    """Citation and context block per cited chunk.

    ``questions``: query_id, embedding, top_k. ``chunks``: chunk_id, embedding,
    document_name, page, section, text.
    """
    head = small_question_set(questions)
    if head is not None:
        candidates = nearest_by_broadcast(questions, chunks, head)
    else:
        candidates = nearest_by_cells(questions, chunks)
    kept = top_k_cut(within_distance(candidates, mode, threshold))
    return cited_rows(retrieved_rows(kept, chunks, bounded=head is not None))


def question_contexts(
    questions: DataFrame, chunks: DataFrame, mode: str = "strict", threshold: float = fixed.DISTANCE_THRESHOLD
) -> DataFrame:
    """Citations, context count and joined context per question that has any."""
    return collect_context(cited_chunks(questions, chunks, mode, threshold))


def distinct_questions(questions: DataFrame, embedder: Embedder = hashed_word_embedder) -> DataFrame:
    """Valid questions, each (text, top_k) once, with its key and vector.

    Equal questions are searched once; answers go back by ``cache_key``.
    """
    keyed = with_cache_key(valid_questions(questions))
    once = keyed.groupBy("cache_key").agg(
        F.min_by("query", "query_id").alias("query"), F.first("top_k").alias("top_k")
    )
    return embed(once.withColumnRenamed("cache_key", "query_id"), text="query", embedder=embedder)
