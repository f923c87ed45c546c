"""Distances, nearest chunks, citations, context, prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from citemill.functions import fixed_values as fixed
from citemill.functions.answers import public_citations
from citemill.operators import retrieval as rt
from citemill.operators.knn import nearest_by_cells, nearest_chunks, nearest_in_probed_cells, recall
from citemill.operators.vectors import cosine_distance
from citemill.plans.questions import cited_chunks, question_contexts
from citemill.registry import inputs as given
from citemill.registry.catalog import register

SEARCH = (given.QUESTIONS, given.CHUNKS, given.PAIRS)
WIDE = (*SEARCH, given.cited_cte(given.WIDE_THRESHOLD))
SYSTEM = fixed.SYSTEM_INSTRUCTION.replace("'", "''")
STRICT = (*SEARCH, given.cited_cte(0.55))


def _candidates(spark, folder):
    return nearest_chunks(given.questions(spark, folder), given.chunks(spark, folder))


def _cited(spark, folder):
    return cited_chunks(given.questions(spark, folder), given.chunks(spark, folder), threshold=given.WIDE_THRESHOLD)


def _contexts(spark, folder):
    return question_contexts(
        given.questions(spark, folder), given.chunks(spark, folder), threshold=given.WIDE_THRESHOLD
    )


def flagship(spark, folder):
    """Top cited chunks of every question."""
    return _cited(spark, folder).select("query_id", "rank", "citation.*").drop("index")


@register(
    "t3_cosine_distance",
    """SELECT vec_id, round(1 - list_inner_product(a, b) / (sqrt(list_inner_product(a, a)) * sqrt(list_inner_product(b, b))), 9) AS distance
       FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a, list_reverse(CAST(embedding AS DOUBLE[])) AS b FROM embeddings)""",
)
def t3(spark, folder):
    """Each vector against its own reversal."""
    return given.table(spark, folder, "embeddings").select(
        "vec_id", F.round(cosine_distance(F.col("embedding"), F.reverse("embedding")), 9).alias("distance")
    )


@register(
    "j3_knn_join",
    given.with_ctes("SELECT query_id, chunk_id, rank, distance FROM candidates", *SEARCH),
)
def j3(spark, folder):
    return _candidates(spark, folder).select("query_id", "chunk_id", "rank", "distance")


@register(
    "j3_knn_join_by_cells",
    given.with_ctes("SELECT query_id, chunk_id, rank, distance FROM candidates", *SEARCH),
)
def j3_cells(spark, folder):
    """The exact search for question sets too large to broadcast."""
    found = nearest_by_cells(given.questions(spark, folder), given.chunks(spark, folder), cells=32)
    return found.select("query_id", "chunk_id", "rank", "distance")


@register("j4_knn_join_approx")
def j4(spark, folder):
    """Recall of the approximate search against the exact one."""
    asked, held = given.questions(spark, folder), given.chunks(spark, folder)
    return recall(nearest_in_probed_cells(asked, held, cells=32, probes=12), nearest_chunks(asked, held))


@register(
    "j4_recall_reached",
    given.with_ctes(
        """SELECT query_id, CAST(least(2 * top_k, (SELECT count(*) FROM chunks)) AS BIGINT) AS fetched, true AS recall_reached
           FROM questions""",
        given.QUESTIONS, given.CHUNKS,
    ),
)
def j4_reached(spark, folder):
    """Rows that the approximate search gives each question, and whether it finds nine tenths of the exact ones."""
    asked, held = given.questions(spark, folder), given.chunks(spark, folder)
    # The given vectors are close to uniform, so most cells have to be visited for this recall.
    found = nearest_in_probed_cells(asked, held, cells=32, probes=24)
    share = recall(found, nearest_chunks(asked, held)).first()["recall"]
    return found.groupBy("query_id").agg(F.count("*").alias("fetched"), F.lit(share >= 0.9).alias("recall_reached"))


@register(
    "k1_knn_candidates",
    given.with_ctes("SELECT query_id, top_k, count(*) AS fetched FROM candidates GROUP BY ALL", *SEARCH),
)
def k1(spark, folder):
    return _candidates(spark, folder).groupBy("query_id", "top_k").agg(F.count("*").alias("fetched"))


@register(
    "p12_distance_filter_strict",
    given.with_ctes("SELECT query_id, chunk_id, rank FROM candidates WHERE distance <= 0.55", *SEARCH),
)
def p12_strict(spark, folder):
    return rt.within_distance(_candidates(spark, folder), "strict").select("query_id", "chunk_id", "rank")


@register(
    "p12_distance_filter_observed",
    given.with_ctes(
        "SELECT query_id, chunk_id, rank FROM candidates WHERE rank <= top_k", *SEARCH
    ),
)
def p12_observed(spark, folder):
    kept = rt.top_k_cut(rt.within_distance(_candidates(spark, folder), "observed"))
    return kept.select("query_id", "chunk_id", "rank")


@register(
    "k2_top_k_cut",
    given.with_ctes("SELECT query_id, chunk_id, rank, distance FROM candidates WHERE rank <= top_k", *SEARCH),
)
def k2(spark, folder):
    return rt.top_k_cut(_candidates(spark, folder)).select("query_id", "chunk_id", "rank", "distance")


@register(
    "w4_citation_rank",
    given.with_ctes(
        f"""SELECT query_id, chunk_id, rank FROM (
              SELECT query_id, top_k, chunk_id,
                     CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS INTEGER) AS rank
              FROM candidates WHERE distance <= {given.WIDE_THRESHOLD})
            WHERE rank <= top_k""",
        *SEARCH,
    ),
)
def w4(spark, folder):
    kept = rt.within_distance(_candidates(spark, folder), "strict", given.WIDE_THRESHOLD)
    return rt.top_k_cut(kept).select("query_id", "chunk_id", "rank")


@register(
    "p10_citation",
    given.with_ctes(
        "SELECT query_id, rank AS \"index\", document, page, section, snippet, distance FROM cited_parts", *WIDE
    ),
)
def p10(spark, folder):
    return _cited(spark, folder).select("query_id", "citation.*")


@register(
    "p11_context_block", given.with_ctes("SELECT query_id, rank, block FROM cited_parts", *WIDE)
)
def p11(spark, folder):
    return _cited(spark, folder).select("query_id", "rank", "block")


@register("a6_join_context", given.with_ctes("SELECT query_id, context FROM contexts", *WIDE))
def a6(spark, folder):
    return _contexts(spark, folder).select("query_id", "context")


@register(
    "a7_collect_citations",
    given.with_ctes(
        """SELECT query_id, context_count, rank AS "index", document, page, section, snippet, distance
           FROM cited_parts JOIN contexts USING (query_id)""",
        *WIDE,
    ),
)
def a7(spark, folder):
    return _contexts(spark, folder).select("query_id", "context_count", F.inline("citations"))


@register(
    "p18_citation_response",
    given.with_ctes("SELECT query_id, document, page, section, snippet, distance FROM cited_parts", *WIDE),
)
def p18(spark, folder):
    shown = _contexts(spark, folder).select("query_id", public_citations(F.col("citations")).alias("citations"))
    return shown.select("query_id", F.inline("citations"))


@register(
    "j6_positional_zip",
    given.with_ctes(
        "SELECT query_id, document, page, distance FROM cited_parts", *WIDE
    ),
)
def j6(spark, folder):
    """Three result lists of a question put back together by position."""
    lists = _contexts(spark, folder).select(
        "query_id",
        F.col("citations.document").alias("document"),
        F.col("citations.page").alias("page"),
        F.col("citations.distance").alias("distance"),
    )
    return lists.select("query_id", F.inline(F.arrays_zip("document", "page", "distance")))


@register(
    "p13_prompt_payload",
    given.with_ctes(
        f"SELECT query_id, context_count, '{SYSTEM}' AS system_prompt, "
        r"""'REFERENCE CONTEXT:' || chr(10) || context || chr(10) || 'USER QUESTION:' || chr(10)
              || query || chr(10) || chr(10)
              || 'Provide a structured, beautifully formatted answer with code blocks and inline [1], [2] citations:' AS user_prompt
           FROM contexts JOIN questions USING (query_id)""",
        *WIDE,
    ),
)
def p13(spark, folder):
    return rt.prompts(given.questions(spark, folder), _contexts(spark, folder))


@register(
    "p14_guard_answer",
    given.with_ctes(
        """SELECT query_id, coalesce(context_count, 0) AS context_count,
             CASE WHEN (SELECT count(*) FROM chunks) = 0 THEN 'No Standard Operating Procedures (SOPs) have been indexed yet. Please trigger an ingestion scan first.'
                  WHEN coalesce(context_count, 0) = 0 THEN 'I don''t know based on the provided documents.' END AS answer
           FROM questions LEFT JOIN contexts USING (query_id)""",
        *STRICT,
    ),
)
def p14(spark, folder):
    """Under the documented threshold."""
    asked, held = given.questions(spark, folder), given.chunks(spark, folder)
    return rt.guarded_answers(asked, question_contexts(asked, held), held)
