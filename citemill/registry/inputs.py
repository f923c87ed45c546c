"""Inputs the registered queries share: the given tables in the engine's shapes.

Every function has a SQL twin of the same name below it. All of them cover the
whole of their tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citemill.session import prepare_session
from citemill.sources.event_lines import CITATION_TYPE
from citemill.sources.files import pages_from_arrays

PAGE_CHARS = 1500
SOLID_PAGE_CHARS = 3000
# 2024-01-01T00:00:00.123Z
FIRST_MODIFIED_MS = 1704067200123


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare_session(spark).read.parquet(f"{folder}/{name}.parquet")


def spread_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents, over all cores even where the file is one small row group.

    A table read as at least as many partitions as there are cores is left alone,
    so a large one is never shuffled for this.
    """
    documents = table(spark, folder, "documents")
    cores = spark.sparkContext.defaultParallelism
    return documents.repartition(cores) if documents.rdd.getNumPartitions() < cores else documents


def with_ctes(query: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + query


# Files: one per document; some names are no PDF, hidden, or in capitals, some files are empty.
def files(spark: SparkSession, folder: str) -> DataFrame:
    source = F.col("source")
    name = F.concat(
        F.when(source == "src7", ".").otherwise(""),
        F.lit("doc_"),
        F.col("doc_id").cast("string"),
        F.when(source == "src3", ".txt").when(source == "src5", ".PDF").otherwise(".pdf"),
    )
    return table(spark, folder, "documents").select(
        F.concat(F.lit("/data/"), source, F.lit("/"), name).alias("absolute_path"),
        F.when(source == "src11", 0).otherwise(F.col("n_chars")).alias("length"),
        (F.lit(FIRST_MODIFIED_MS) + F.col("doc_id") * 60000).alias("modified_ms"),
        "doc_id",
    )


FILES = f"""files AS (
  SELECT '/data/' || source || '/' || CASE WHEN source = 'src7' THEN '.' ELSE '' END || 'doc_' || doc_id
           || CASE source WHEN 'src3' THEN '.txt' WHEN 'src5' THEN '.PDF' ELSE '.pdf' END AS absolute_path,
         CASE WHEN source = 'src11' THEN 0 ELSE n_chars END AS length,
         {FIRST_MODIFIED_MS} + doc_id * 60000 AS modified_ms,
         doc_id
  FROM documents)"""


# Manifest: files that have a label were seen before; poor ones earlier, toxic ones later.
def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return files(spark, folder).join(table(spark, folder, "labels"), "doc_id").select(
        "absolute_path",
        (
            F.col("modified_ms")
            + F.when(F.col("toxic") == 1, 60000).when(F.col("quality") == 0, -60000).otherwise(0)
        ).alias("modified_ms"),
    )


MANIFEST = """manifest AS (
  SELECT absolute_path,
         modified_ms + CASE WHEN toxic = 1 THEN 60000 WHEN quality = 0 THEN -60000 ELSE 0 END AS modified_ms
  FROM files JOIN labels USING (doc_id))"""

PAYLOADS = """payloads AS (
  SELECT list_extract(string_split(absolute_path, '/'), -1) AS file_name, absolute_path,
         greatest(1, length // 1024) AS file_size_kb,
         make_timestamp(modified_ms * 1000) AS last_modified
  FROM files)"""


# Pages: blocks of every text with boilerplate and headers put in front, and a
# last page of boilerplate alone, which cleaning leaves empty.
def sop_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document with its page texts in an array."""
    count = F.greatest(F.ceil(F.length("text") / PAGE_CHARS).cast("int"), F.lit(1))

    def page_text(block):
        prefix = (
            F.when(block == 0, "Revision Date Approved by: QA\n")
            .when(block % 3 == 1, F.concat(F.lit("SECTION "), block.cast("string"), F.lit("\n")))
            .otherwise("laboratory safety MANUAL \n\n")
        )
        return F.concat(prefix, F.substring(F.col("text"), block * PAGE_CHARS + 1, F.lit(PAGE_CHARS)))

    texts = F.transform(F.sequence(F.lit(0), count - 1), page_text)
    return spread_documents(spark, folder).select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("document_name"),
        F.concat(F.lit("/data/"), "source").alias("file_path"),
        F.array_append(texts, F.lit("REVISION DATE approved by: QA")).alias("pages"),
    )


def sop_pages(spark: SparkSession, folder: str) -> DataFrame:
    return pages_from_arrays(sop_documents(spark, folder))


SOP_PAGES = f"""sop_blocks AS (
  SELECT 'doc_' || doc_id || '.pdf' AS document_name, '/data/' || source AS file_path, text,
         greatest(CAST(ceil(length(text) / {PAGE_CHARS}.0) AS INTEGER), 1) AS n
  FROM documents),
sop_pages AS (
  SELECT document_name, file_path, CAST(block + 1 AS INTEGER) AS page, n + 1 AS total_pages,
         CASE WHEN block = n THEN 'REVISION DATE approved by: QA'
              ELSE CASE WHEN block = 0 THEN 'Revision Date Approved by: QA' || chr(10)
                        WHEN block % 3 = 1 THEN 'SECTION ' || block || chr(10)
                        ELSE 'laboratory safety MANUAL ' || chr(10) || chr(10) END
                   || substr(text, block * {PAGE_CHARS} + 1, {PAGE_CHARS}) END AS raw_text
  FROM (SELECT *, unnest(range(n + 1)) AS block FROM sop_blocks))"""

CLEAN_PAGES = r"""clean_pages AS (
  SELECT document_name, file_path, page, total_pages,
         trim(regexp_replace(regexp_replace(regexp_replace(raw_text,
           '(?i)Revision Date Approved by:.*?(?:\n|$)', '', 'g'),
           '(?i)Laboratory Safety Manual\s*', '', 'g'),
           '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text
  FROM sop_pages)"""

FOUND_HEADERS = r"""found_headers AS (
  SELECT *, substr(list_filter(list_filter(list_transform(string_split(text, chr(10)),
              lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13))), lambda x: x <> '')[1:5],
              lambda x: regexp_matches(x, '^(\d+(\.\d+)*\s+[A-Z0-9\s\-/]{3,}|SECTION\s+[A-Z0-9]+|APPENDIX\s+[A-Z0-9\:\s]+|[A-Z\s]{4,})')
                        AND length(x) > 3 AND NOT starts_with(lower(x), 'page'))[1], 1, 90) AS header
  FROM clean_pages WHERE length(text) > 0)"""


# Solid pages: blocks of every text without its whitespace. They have no separator,
# so their chunks are known in closed form.
def solid_pages(spark: SparkSession, folder: str, names: DataFrame | None = None) -> DataFrame:
    """Pages of all documents, or of those with a ``document_name`` in ``names``.

    The documents are chosen before their pages are made: Spark moves no join below an
    explode, and so the work is that of the documents asked for.
    """
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("document_name")
    documents = spread_documents(spark, folder).select(name, "source", "text")
    if names is not None:
        documents = documents.join(names, "document_name", "left_semi")
    solid = F.regexp_replace("text", r"\s", "")
    count = F.greatest(F.ceil(F.length("solid") / SOLID_PAGE_CHARS).cast("int"), F.lit(1))
    texts = F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda block: F.substring(F.col("solid"), block * SOLID_PAGE_CHARS + 1, F.lit(SOLID_PAGE_CHARS)),
    )
    return (
        documents.select("document_name", "source", solid.alias("solid"))
        .select(
            "document_name",
            F.concat(F.lit("/data/"), "source").alias("file_path"),
            count.alias("total_pages"),
            F.posexplode(texts).alias("block", "raw_text"),
        )
        .select("document_name", "file_path", (F.col("block") + 1).alias("page"), "total_pages", "raw_text")
    )


SOLID_PAGES = rf"""solid_texts AS (
  SELECT 'doc_' || doc_id || '.pdf' AS document_name, '/data/' || source AS file_path,
         regexp_replace(text, '\s', '', 'g') AS solid
  FROM documents),
solid_blocks AS (
  SELECT *, greatest(CAST(ceil(length(solid) / {SOLID_PAGE_CHARS}.0) AS INTEGER), 1) AS n FROM solid_texts),
solid_pages AS (
  SELECT document_name, file_path, CAST(block + 1 AS INTEGER) AS page, n AS total_pages,
         substr(solid, block * {SOLID_PAGE_CHARS} + 1, {SOLID_PAGE_CHARS}) AS text
  FROM (SELECT *, unnest(range(n)) AS block FROM solid_blocks))"""

SOLID_CHUNKS = r"""solid_headers AS (
  SELECT *, CASE WHEN regexp_matches(text, '^(SECTION\s+[A-Z0-9]+|[A-Z\s]{4,})') AND NOT starts_with(lower(text), 'page')
                 THEN substr(text, 1, 90) END AS header
  FROM solid_pages WHERE length(text) > 0),
solid_sections AS (
  SELECT *, coalesce(last_value(header IGNORE NULLS) OVER (PARTITION BY document_name ORDER BY page
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'General Overview') AS section
  FROM solid_headers),
solid_pieces AS (
  SELECT *, CAST(unnest(range(CASE WHEN length(text) <= 1000 THEN 1
                                   ELSE 1 + CAST(ceil((length(text) - 1000) / 800.0) AS INTEGER) END)) AS INTEGER) AS index_in_page
  FROM solid_sections),
solid_parts AS (
  SELECT document_name, file_path, page, total_pages, section, index_in_page,
         row_number() OVER (PARTITION BY document_name ORDER BY page, index_in_page) - 1 AS chunk_index,
         substr(text, 800 * index_in_page + 1, 1000) AS text
  FROM solid_pieces),
solid_chunks AS (
  SELECT *, substr(sha256(text), 1, 12) AS chunk_hash,
         document_name || '_p' || page || '_c' || index_in_page || '_' || substr(sha256(text), 1, 12) AS chunk_id
  FROM solid_parts)"""


# Questions and chunks with given vectors.
def questions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("query_id"),
        "embedding",
        (1 + F.col("vec_id") % 10).cast("int").alias("top_k"),
        F.concat(F.lit("What is label "), F.col("label").cast("string"), F.lit("?")).alias("query"),
    )


QUESTIONS = """questions AS (
  SELECT vec_id AS query_id, embedding, CAST(1 + vec_id % 10 AS INTEGER) AS top_k,
         'What is label ' || label || '?' AS query
  FROM embeddings)"""


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return vectors.join(document_chunks(spark, folder), "chunk_id")


def document_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a chunk, for what needs no vector."""
    return spread_documents(spark, folder).select(
        F.col("doc_id").alias("chunk_id"),
        F.when(F.col("source") != "src3", F.col("source")).alias("document_name"),
        F.when(F.col("lang") != "fr", 1 + F.col("doc_id") % 9).cast("int").alias("page"),
        F.when(F.col("lang") != "es", F.concat(F.lit("Section "), "lang")).alias("section"),
        "text",
        F.col("doc_id").alias("chunk_index"),
        F.when(F.col("source") != "src4", F.concat(F.lit("/data/"), "source")).alias("file_path"),
        F.when(F.col("source") != "src5", F.col("n_chars").cast("int")).alias("total_pages"),
    )


_CHUNK_COLUMNS = """CASE WHEN source <> 'src3' THEN source END AS document_name,
         CASE WHEN lang <> 'fr' THEN CAST(1 + doc_id % 9 AS INTEGER) END AS page,
         CASE WHEN lang <> 'es' THEN 'Section ' || lang END AS section,
         text, doc_id AS chunk_index,
         CASE WHEN source <> 'src4' THEN '/data/' || source END AS file_path,
         CASE WHEN source <> 'src5' THEN CAST(n_chars AS INTEGER) END AS total_pages"""

CHUNKS = f"""chunks AS (
  SELECT vec_id AS chunk_id, embedding,
         {_CHUNK_COLUMNS}
  FROM embeddings JOIN documents ON vec_id = doc_id)"""

DOCUMENT_CHUNKS = f"""chunks AS (
  SELECT doc_id AS chunk_id,
         {_CHUNK_COLUMNS}
  FROM documents)"""

PAIRS = """pairs AS (
  SELECT query_id, top_k, chunk_id,
         greatest(round(1 - list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))
           / (sqrt(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))
            * sqrt(list_inner_product(CAST(c.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])))), 9), 0) + 0.0 AS distance
  FROM questions q, chunks c),
candidates AS (
  SELECT * FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS INTEGER) AS rank
    FROM pairs)
  WHERE rank <= 2 * top_k)"""

# The documented threshold cuts most of the given vectors; the wider one keeps more.
WIDE_THRESHOLD = 0.65


def cited_cte(threshold: float) -> str:
    return f"""kept AS (SELECT * FROM candidates WHERE distance <= {threshold} AND rank <= top_k),
cited AS (
  SELECT query_id, rank, coalesce(document_name, 'Unknown SOP') AS document, coalesce(page, 1) AS page,
         coalesce(section, 'General') AS section, text, round(distance, 4) AS distance,
         trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat
  FROM kept JOIN chunks USING (chunk_id)),
cited_parts AS (
  SELECT *, CASE WHEN length(flat) > 240 THEN substr(flat, 1, 240) || '...' ELSE flat END AS snippet,
         '[' || rank || '] Document: ' || document || ' | Section: ' || section || ' | Page: ' || page
           || chr(10) || 'Excerpt: ' || text || chr(10) AS block
  FROM cited),
contexts AS (
  SELECT query_id, string_agg(block, chr(10) ORDER BY rank) AS context, CAST(count(*) AS INTEGER) AS context_count
  FROM cited_parts GROUP BY query_id)"""


# Answers and their events, out of the conversations.
def answers(spark: SparkSession, folder: str) -> DataFrame:
    tail = (
        F.when(F.col("turn") % 4 == 1, "\nReferences: x")
        .when(F.col("turn") % 4 == 3, "\n## References")
        .otherwise("")
    )
    return table(spark, folder, "conversations").filter("role = 'assistant'").select(
        "conv_id",
        "turn",
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id"),
        F.concat("text", F.lit(" [1] and [2]"), tail).alias("answer"),
    )


ANSWERS = """answers AS (
  SELECT conv_id, turn, conv_id || ':' || turn AS request_id,
         text || ' [1] and [2]' || CASE turn % 4 WHEN 1 THEN chr(10) || 'References: x'
                                                 WHEN 3 THEN chr(10) || '## References' ELSE '' END AS answer
  FROM conversations WHERE role = 'assistant')"""


def answer_events(spark: SparkSession, folder: str) -> DataFrame:
    cited = F.array(
        F.struct(
            F.lit(1).alias("index"), F.col("request_id").alias("document"), F.lit(2).alias("page"),
            F.lit("General").alias("section"), F.lit("x").alias("snippet"), F.lit(0.25).alias("distance"),
        )
    )
    said = answers(spark, folder).withColumn("words", F.split("answer", " "))
    text, no_citations = F.lit(None).cast("string"), F.lit(None).cast(f"array<{CITATION_TYPE}>")
    opening = said.select(
        "request_id", F.lit(0).cast("bigint").alias("seq"), F.lit("citations").alias("type"),
        text.alias("content"), text.alias("full_answer"), cited.alias("citations"),
    )
    tokens = said.select("request_id", F.posexplode("words").alias("at", "word")).select(
        "request_id", (F.col("at") + 1).cast("bigint").alias("seq"), F.lit("token").alias("type"),
        F.concat("word", F.lit(" ")).alias("content"), text.alias("full_answer"), no_citations.alias("citations"),
    )
    done = said.filter("conv_id % 2 = 0").select(
        "request_id", (F.size("words") + 1).cast("bigint").alias("seq"), F.lit("done").alias("type"),
        text.alias("content"), F.concat(F.lit("Final: "), "answer").alias("full_answer"), no_citations.alias("citations"),
    )
    return opening.unionByName(tokens).unionByName(done)


ANSWER_EVENTS = """said AS (SELECT *, string_split(answer, ' ') AS words FROM answers),
answer_events AS (
  SELECT request_id, CAST(0 AS BIGINT) AS seq, 'citations' AS type, NULL AS content, NULL AS full_answer FROM said
  UNION ALL
  SELECT request_id, CAST(place AS BIGINT), 'token', words[place] || ' ', NULL
  FROM (SELECT *, unnest(range(1, len(words) + 1)) AS place FROM said)
  UNION ALL
  SELECT request_id, CAST(len(words) + 1 AS BIGINT), 'done', NULL, 'Final: ' || answer FROM said WHERE conv_id % 2 = 0)"""


# The question log and the ingests between, out of the events.
def question_log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        "event_id",
        "ts",
        F.concat(F.lit("  "), F.upper("event_type"), F.lit(" \t")).alias("query"),
        F.when(F.col("user_id") % 12 != 5, F.col("user_id") % 12).cast("int").alias("top_k"),
        (F.col("event_type") != "error").alias("cacheable"),
        "value",
    )


QUESTION_LOG = """question_log AS (
  SELECT event_id, ts, '  ' || upper(event_type) || ' ' || chr(9) AS query,
         CAST(CASE WHEN user_id % 12 <> 5 THEN user_id % 12 END AS INTEGER) AS top_k,
         event_type <> 'error' AS cacheable, value
  FROM events),
keyed_log AS (
  SELECT event_id, ts, cacheable, value, lower(trim(query, ' ' || chr(9))) AS query, coalesce(top_k, 4) AS top_k,
         sha256(lower(trim(query, ' ' || chr(9))) || '_' || coalesce(top_k, 4)) AS cache_key
  FROM question_log WHERE coalesce(top_k, 4) BETWEEN 1 AND 10)"""


def ingests(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").filter(F.col("props") == '{"k": 99}').select("event_id", "ts")


INGESTS = """ingests AS (SELECT event_id, ts FROM events WHERE props = '{"k": 99}')"""
