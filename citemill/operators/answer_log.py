"""Answers folded from event rows, and the size rule of the answer table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citemill.functions import fixed_values as fixed

FOLD_BLOCK = 512


def fold_events(events: DataFrame, block_rows: int = FOLD_BLOCK) -> DataFrame:
    """One row per request: final text and last citations.

    ``events``: request_id, seq, type, content, full_answer, citations. Token
    texts join in ``seq`` order; a ``done`` event's full answer replaces them,
    and the last event that carries citations decides those.

    Tokens are joined per run of ``seq`` values first and the runs after that,
    so a request with very many events is sorted in many tasks.
    """
    is_token = F.col("type") == "token"
    has_answer = (F.col("type") == "done") & F.col("full_answer").isNotNull()
    has_citations = F.col("type").isin("citations", "done") & F.col("citations").isNotNull()
    runs = events.groupBy("request_id", F.floor(F.col("seq") / block_rows).alias("run")).agg(
        F.array_sort(F.collect_list(F.when(is_token, F.struct("seq", "content")))).alias("tokens"),
        F.count_if(is_token).alias("token_count"),
        F.max_by("full_answer", F.when(has_answer, F.col("seq"))).alias("full_answer"),
        F.max_by("citations", F.when(has_citations, F.col("seq"))).alias("citations"),
        F.max(F.when(has_answer, F.col("seq"))).alias("answer_seq"),
        F.max(F.when(has_citations, F.col("seq"))).alias("citation_seq"),
    )
    joined = runs.select(
        "request_id", "run", "token_count", "full_answer", "citations", "answer_seq", "citation_seq",
        F.array_join(F.transform("tokens", lambda token: token["content"]), "").alias("text"),
    )
    whole = joined.groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct("run", "text"))).alias("runs"),
        F.sum("token_count").alias("token_count"),
        F.max_by("full_answer", "answer_seq").alias("full_answer"),
        F.max_by("citations", "citation_seq").alias("citations"),
    )
    streamed = F.array_join(F.transform("runs", lambda run: run["text"]), "")
    return whole.select(
        "request_id",
        F.coalesce("full_answer", streamed).alias("answer"),
        "token_count",
        "citations",
        F.col("full_answer").isNotNull().alias("finished"),
    )


def prune_answers(
    answers: DataFrame, limit: int = fixed.CACHE_LIMIT, evict: int = fixed.CACHE_EVICT
) -> DataFrame:
    """Drop the ``evict`` oldest answers when more than ``limit`` are kept.

    The oldest are found by a distributed top-n, so no task sorts the table.
    """
    stored = answers.select(F.count("*").alias("n")).scalar()
    oldest = (
        answers.select("cache_key", "answer_ts").orderBy("answer_ts", "cache_key").limit(evict)
        .filter(stored > limit)
        .select("cache_key")
    )
    # ``oldest`` has at most ``evict`` rows.
    return answers.join(F.broadcast(oldest) if evict <= 10_000 else oldest, "cache_key", "left_anti")


def live_answers(questions: DataFrame, answers: DataFrame, ttl_seconds: int = fixed.CACHE_TTL_SECONDS) -> DataFrame:
    """Questions with the kept answer; a hit if it was there already and is younger than the TTL."""
    age = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("answer_ts").cast("timestamp"))
    return questions.join(answers, "cache_key", "left").withColumn(
        "hit", F.coalesce((age >= 0) & (age < ttl_seconds * 1_000_000), F.lit(False))
    )
