"""Splitting, numbering, the chunk table and its summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from citemill.operators import catalog as cat
from citemill.functions.sql import register_sql_functions
from citemill.functions.text import strip
from citemill.operators.chunking import chunk_pages, clean_pages, split_chunks
from citemill.operators.vectors import embed, missing_vectors, table_embedder
from citemill.registry import inputs as given
from citemill.registry.catalog import register
from citemill.session import scratch_path
from citemill.sources.store import ChunkStore

SOLID = (given.SOLID_PAGES, given.SOLID_CHUNKS)


def _solid_chunks(spark, folder):
    return chunk_pages(given.solid_pages(spark, folder))


@register("t1_split_chunks")
def t1(spark, folder):
    """Every page of every text; the SQL-checked form is ``t1_split_solid``."""
    pages = clean_pages(given.sop_pages(spark, folder))
    return pages.select("document_name", "page", F.posexplode(split_chunks(F.col("text"))).alias("index_in_page", "text"))


@register(
    "t1_split_solid",
    given.with_ctes(
        """SELECT document_name, place AS index_in_page, substr(solid, CAST(800 * place + 1 AS BIGINT), 1000) AS text
           FROM (SELECT *, CAST(unnest(range(CASE WHEN length(solid) <= 1000 THEN 1
                                    ELSE 1 + CAST(ceil((length(solid) - 1000) / 800.0) AS INTEGER) END)) AS INTEGER) AS place
                 FROM solid_texts WHERE length(solid) > 0)""",
        given.SOLID_PAGES,
    ),
)
def t1_solid(spark, folder):
    """Whole texts without whitespace, whose chunks have a closed form."""
    return given.spread_documents(spark, folder).select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("document_name"),
        F.posexplode(split_chunks(F.regexp_replace("text", r"\s", ""))).alias("index_in_page", "text"),
    )


# Single spaces and no other separator; words of at most 500 characters.
FLAT_MARKS, FLAT_LONG = r"([.;]*[ \t\n\r]+)+", r"([^ ]{500})"


@register(
    "t1_split_lateral",
    f"""WITH RECURSIVE flat AS (
          SELECT doc_id, trim(regexp_replace(regexp_replace(text, '{FLAT_MARKS}', ' ', 'g'), '{FLAT_LONG}', '\\1 ', 'g')) AS t
          FROM documents),
        words AS (SELECT doc_id, t, string_split(t, ' ') AS w FROM flat WHERE t <> ''),
        pieces AS (SELECT doc_id, unnest(range(len(w))) AS k, length(unnest(w)) AS n FROM words),
        starts AS (
          SELECT doc_id, k, CASE WHEN k = 0 THEN 0
            ELSE CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) + k - 1 END AS pos
          FROM pieces),
        cuts AS (
          SELECT doc_id, any_value(t) AS t, list_append(list(pos ORDER BY k), length(any_value(t))) AS b
          FROM starts JOIN words USING (doc_id) GROUP BY doc_id),
        chunks AS (
          SELECT doc_id, t, b, 0 AS place, CAST(1 AS BIGINT) AS s, len(list_filter(b, lambda x: x <= 1000)) AS e FROM cuts
          UNION ALL
          SELECT doc_id, t, b, place + 1, n, len(list_filter(b, lambda x: x <= b[n] + 1000)) FROM (
            SELECT *, least(greatest(s, 1 + len(list_filter(b, lambda x: x < greatest(b[e] - 200, b[e + 1] - 1000)))), e) AS n
            FROM chunks WHERE e < len(b)))
        SELECT doc_id, place AS index_in_page, trim(substr(t, b[s] + 1, b[e] - b[s])) AS text FROM chunks""",
)
def t1_lateral(spark, folder):
    """The splitter as a table function in SQL, on texts of words parted by single spaces."""
    register_sql_functions(spark)
    flat = F.trim(F.regexp_replace(F.regexp_replace("text", FLAT_MARKS, " "), FLAT_LONG, "$1 "))
    documents = given.spread_documents(spark, folder).select("doc_id", flat.alias("flat"))
    return spark.sql(
        "SELECT d.doc_id, c.index_in_page, c.text FROM {documents} d, LATERAL split_chunks(d.flat) c", documents=documents
    )


@register(
    "t1_chunk_invariants",
    given.with_ctes(
        """SELECT document_name, page, true AS all_fit, true AS all_in_page, true AS starts, true AS ends
           FROM clean_pages WHERE length(text) > 0""",
        given.SOP_PAGES, given.CLEAN_PAGES,
    ),
)
def t1_invariants(spark, folder):
    """Per page: chunks are short enough and parts of the page, the first starts it and the last ends it."""
    pages = clean_pages(given.sop_pages(spark, folder)).withColumn("chunks", split_chunks(F.col("text")))
    page = strip(F.col("text"))
    return pages.select(
        "document_name",
        "page",
        F.forall("chunks", lambda c: F.length(c) <= 1000).alias("all_fit"),
        F.forall("chunks", lambda c: F.contains(F.col("text"), c)).alias("all_in_page"),
        F.startswith(page, F.get("chunks", F.lit(0))).alias("starts"),
        F.endswith(page, F.element_at("chunks", -1)).alias("ends"),
    )


@register(
    "w2_chunk_index",
    given.with_ctes(
        "SELECT document_name, page, index_in_page, chunk_index, section FROM solid_chunks", *SOLID
    ),
)
def w2(spark, folder):
    return _solid_chunks(spark, folder).select("document_name", "page", "index_in_page", "chunk_index", "section")


@register(
    "w3_index_in_page",
    given.with_ctes(
        """SELECT document_name, page, CAST(max(index_in_page) AS INTEGER) AS last_index, count(*) AS chunks
           FROM solid_chunks GROUP BY ALL""",
        *SOLID,
    ),
)
def w3(spark, folder):
    return _solid_chunks(spark, folder).groupBy("document_name", "page").agg(
        F.max("index_in_page").alias("last_index"), F.count("*").alias("chunks")
    )


@register("p6_chunk_id", given.with_ctes("SELECT chunk_id, chunk_hash FROM solid_chunks", *SOLID))
def p6(spark, folder):
    return _solid_chunks(spark, folder).select("chunk_id", "chunk_hash")


@register(
    "s11_collection_scan",
    given.with_ctes(
        """SELECT chunk_id, document_name, file_path, page, total_pages, section, chunk_index, chunk_hash, text
           FROM solid_chunks""",
        *SOLID,
    ),
)
def s11(spark, folder):
    """Chunks published to a store and read back through its live table."""
    pages = given.solid_pages(spark, folder)
    store = ChunkStore(spark, scratch_path(spark, "store"))
    store.publish(chunk_pages(pages), pages)
    return store.read().drop("version", "index_in_page")


@register(
    "s12_collection_lookup",
    "SELECT doc_id, source, lang, text FROM documents WHERE source = 'src5'",
)
def s12(spark, folder):
    chunks = given.table(spark, folder, "documents").withColumnRenamed("source", "document_name")
    return cat.lookup_document(chunks, "src5").withColumnRenamed("document_name", "source").drop("n_chars")


REPLACED_PARTS = """incoming AS (
  SELECT DISTINCT document_name FROM chunks JOIN labels ON chunk_id = doc_id
  WHERE toxic = 1 AND document_name IS NOT NULL),
fresh AS (
  SELECT chunk_id, document_name, page, 'again ' || section AS section FROM chunks
  JOIN labels ON chunk_id = doc_id
  WHERE quality = 1 AND document_name IN (SELECT document_name FROM incoming))"""


def _replacement(spark, folder):
    """Documents with a toxic chunk are read again and keep only their good chunks."""
    existing = given.document_chunks(spark, folder).select("chunk_id", "document_name", "page", "section")
    labels = given.table(spark, folder, "labels")
    labelled = existing.join(labels, existing["chunk_id"] == labels["doc_id"])
    processed = labelled.filter("toxic = 1 AND document_name IS NOT NULL").select("document_name").distinct()
    fresh = (
        labelled.filter("quality = 1")
        .join(processed, "document_name", "left_semi")
        .select("chunk_id", "document_name", "page", F.concat(F.lit("again "), "section").alias("section"))
    )
    return existing, processed, fresh


@register(
    "s12_store_lookup",
    given.with_ctes(
        """SELECT chunk_id, document_name, page, section FROM chunks WHERE document_name = 'src5'
           AND document_name NOT IN (SELECT document_name FROM incoming)
           UNION ALL SELECT * FROM fresh WHERE document_name = 'src5'
           UNION ALL SELECT chunk_id, document_name, page, section FROM chunks WHERE document_name IS NULL""",
        given.DOCUMENT_CHUNKS, REPLACED_PARTS,
    ),
)
def s12_store(spark, folder):
    """One document, and the rows without a name, looked up in a store after a replacement."""
    existing, processed, fresh = _replacement(spark, folder)
    store = ChunkStore(spark, scratch_path(spark, "store"))
    store.publish(existing, existing)
    store.publish(fresh, processed)
    return store.lookup("src5").unionByName(store.lookup(None)).drop("version")


@register(
    "s10_replace_document",
    given.with_ctes(
        """SELECT chunk_id, document_name, page, section FROM chunks
           WHERE document_name IS NULL OR document_name NOT IN (SELECT document_name FROM incoming)
           UNION ALL SELECT * FROM fresh""",
        given.DOCUMENT_CHUNKS, REPLACED_PARTS,
    ),
)
def s10(spark, folder):
    return cat.replace_documents(*_replacement(spark, folder))


@register(
    "s10_versioned_publish",
    given.with_ctes(
        """SELECT chunk_id, document_name, page, section FROM chunks
           WHERE document_name IS NULL OR document_name NOT IN (SELECT document_name FROM incoming)
           UNION ALL SELECT * FROM fresh""",
        given.DOCUMENT_CHUNKS, REPLACED_PARTS,
    ),
)
def s10_versioned(spark, folder):
    """The same replacement as two publishes to the versioned store, then compacted and vacuumed."""
    existing, processed, fresh = _replacement(spark, folder)
    store = ChunkStore(spark, scratch_path(spark, "store"))
    store.publish(existing, existing)
    store.publish(fresh, processed)
    store.compact()
    store.vacuum(0)
    return store.read().drop("version")


@register(
    "j2_replaced_rows",
    given.with_ctes(
        """SELECT chunk_id, document_name FROM chunks
           WHERE document_name IS NULL OR document_name NOT IN (SELECT document_name FROM incoming)""",
        given.DOCUMENT_CHUNKS, REPLACED_PARTS,
    ),
)
def j2(spark, folder):
    existing, processed, _ = _replacement(spark, folder)
    return existing.join(processed, "document_name", "left_anti").select("chunk_id", "document_name")


@register(
    "a1_document_catalog",
    given.with_ctes(
        """SELECT coalesce(document_name, 'Unknown') AS document_name,
             coalesce(arg_min(file_path, chunk_index), '') AS file_path,
             coalesce(arg_min(total_pages, chunk_index), 0) AS total_pages,
             count(*) AS chunk_count
           FROM (SELECT document_name, chunk_index, coalesce(file_path, '') AS file_path,
                        coalesce(total_pages, 0) AS total_pages FROM chunks)
           GROUP BY 1""",
        given.DOCUMENT_CHUNKS,
    ),
)
def a1(spark, folder):
    return cat.document_catalog(given.document_chunks(spark, folder))


@register(
    "a2_chunk_count",
    given.with_ctes("SELECT count(*) AS total_chunks FROM solid_chunks", *SOLID),
)
def a2(spark, folder):
    return cat.chunk_count(_solid_chunks(spark, folder))


@register(
    "a3_ingest_receipt",
    given.with_ctes(
        """SELECT 'success' AS status, p.document_name, p.total_pages, coalesce(c.n, 0) AS chunks_indexed
           FROM (SELECT document_name, max(total_pages) AS total_pages FROM solid_pages GROUP BY 1) p
           LEFT JOIN (SELECT document_name, count(*) AS n FROM solid_chunks GROUP BY 1) c USING (document_name)""",
        *SOLID,
    ),
)
def a3(spark, folder):
    pages = given.solid_pages(spark, folder)
    return cat.ingest_receipts(pages, chunk_pages(pages))


@register(
    "t2_embed_from_table",
    """SELECT doc_id, place, CAST(list_extract(embedding, place) AS FLOAT) AS value FROM (
         SELECT doc_id, embedding, unnest(range(1, len(embedding) + 1)) AS place
         FROM documents JOIN embeddings ON vec_id = doc_id)
       UNION ALL SELECT doc_id, NULL, NULL FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""",
)
def t2_table(spark, folder):
    """Vectors supplied as a table, value by value; a document without one has one row of nulls."""
    vectors = given.table(spark, folder, "embeddings").withColumnRenamed("vec_id", "doc_id")
    documents = given.table(spark, folder, "documents").select("doc_id", "text")
    embedded = embed(documents, embedder=table_embedder(vectors, "doc_id"))
    return embedded.select("doc_id", F.posexplode_outer("embedding").alias("at", "value")).select(
        "doc_id", (F.col("at") + 1).cast("bigint").alias("place"), "value"
    )


@register(
    "t2_missing_vectors",
    """SELECT source, count(*) AS n_rows, count(*) FILTER (vec_id IS NULL) AS n_missing
       FROM documents LEFT JOIN embeddings ON vec_id = doc_id GROUP BY source""",
)
def t2_missing(spark, folder):
    vectors = given.table(spark, folder, "embeddings").withColumnRenamed("vec_id", "doc_id")
    documents = given.table(spark, folder, "documents").select("doc_id", "source", "text")
    return missing_vectors(embed(documents, embedder=table_embedder(vectors, "doc_id")), ["source"])


@register("t2_embed")
def t2(spark, folder):
    """Hashed word vectors of whole texts: non-zero entries and length of each vector."""
    vectors = embed(given.spread_documents(spark, folder).select("doc_id", "text"))
    return vectors.select(
        "doc_id",
        F.size("embedding").alias("size"),
        F.size(F.filter("embedding", lambda x: x != 0)).alias("entries"),
    )
