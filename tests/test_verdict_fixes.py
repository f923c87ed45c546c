"""Cases in which rows were once lost or mislabelled."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from citemill.operators.answer_log import live_answers
from citemill.operators.chunking import chunk_pages
from citemill.operators.knn import nearest_chunks
from citemill.operators.vectors import cosine_distance, hashed_word_embedder
from citemill.plans.ingest import scan_and_ingest
from citemill.sources.store import ChunkStore
from citemill.streaming.poll import start_polling


def test_an_answer_from_the_future_is_no_hit(spark):
    noon = dt.datetime(2024, 1, 1, 12)
    asked = spark.createDataFrame(
        [(i, "k", noon + dt.timedelta(seconds=s)) for i, s in enumerate((-1, 0, 3599, 3600))],
        "id int, cache_key string, ts timestamp_ntz",
    )
    kept = spark.createDataFrame([("k", noon)], "cache_key string, answer_ts timestamp_ntz")
    assert {r.id: r.hit for r in live_answers(asked, kept).collect()} == {0: False, 1: True, 2: True, 3: False}


def test_zero_vectors_are_at_distance_one(spark):
    rows = spark.createDataFrame(
        [([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<double>, b array<double>"
    )
    assert [r.d for r in rows.select(cosine_distance(F.col("a"), F.col("b")).alias("d")).collect()] == [1.0, 0.0, None]


@pytest.mark.parametrize("text,words", [("Привет мир", 2), ("你好 世界", 2), ("Müller été", 2), ("", 0)])
def test_words_of_any_script_are_embedded(spark, text, words):
    rows = spark.createDataFrame([(text,)], "t string")
    vector = hashed_word_embedder(rows, "t", "v").first().v
    assert sum(x > 0 for x in vector) == words


@pytest.mark.parametrize("total", [None, 1])
def test_numbers_run_on_whatever_the_declared_page_count(spark, total):
    pages = spark.createDataFrame(
        [("d", "/d", p, total, "SECTION ONE\nbody" if p == 1 else f"plain text {p}.") for p in range(1, 6)],
        "document_name string, file_path string, page int, total_pages int, raw_text string",
    )
    rows = chunk_pages(pages, block_rows=2).orderBy("page").collect()
    assert [r.chunk_index for r in rows] == [0, 1, 2, 3, 4]
    assert len({r.section for r in rows}) == 1


def test_too_large_top_k_is_refused(spark):
    vectors = [(i, [1.0, float(i)]) for i in range(30)]
    chunks = spark.createDataFrame(vectors, "chunk_id long, embedding array<float>")
    questions = spark.createDataFrame([(1, [1.0, 0.0], 15)], "query_id long, embedding array<float>, top_k int")
    with pytest.raises(Exception, match="top_k above 10"):
        nearest_chunks(questions, chunks).collect()


def test_manual_scans_and_new_checkpoints_hide_no_file(spark, tmp_path):
    store, names = ChunkStore(spark, str(tmp_path / "store")), ["a.pdf"]

    def listing():
        return spark.createDataFrame(
            [(f"/in/{n}", 10, 1) for n in names], "absolute_path string, length long, modified_ms long"
        )

    def pages(files):
        return files.select(
            F.substring_index("absolute_path", "/", -1).alias("document_name"),
            F.col("absolute_path").alias("file_path"),
            F.lit(1).alias("page"),
            F.lit(1).alias("total_pages"),
            F.lit("some text").alias("raw_text"),
        )

    def tick(checkpoint):
        start_polling(store, listing, pages, str(tmp_path / checkpoint), {"availableNow": True}).awaitTermination()

    tick("one")
    names.append("b.pdf")
    scan_and_ingest(store, listing(), pages, manual=True)
    names.append("c.pdf")
    tick("one")
    names.append("d.pdf")
    tick("two")
    assert {r.document_name for r in store.live().collect()} == set(names)
    assert scan_and_ingest(store, listing(), pages).dispatched == 0
