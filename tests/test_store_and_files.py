import os

import pytest

from citemill.operators.catalog import document_catalog
from citemill.plans.ingest import scan_and_ingest
from citemill.plans.questions import distinct_questions, question_contexts
from citemill.sources import files as fs
from citemill.sources.event_lines import read_event_lines, write_event_lines
from citemill.sources.store import ChunkStore

CHUNKS = "chunk_id string, document_name string"


@pytest.fixture
def folder(tmp_path):
    def put(name, body=b"x", modified=1_700_000_000):
        path = tmp_path / name
        path.write_bytes(body)
        os.utime(path, (modified, modified))
        return str(path)

    put("a.pdf", b"x" * 5000)
    put("b.pdf")
    put("empty.pdf", b"")
    put(".hidden.pdf")
    put("note.txt")
    put("B.PDF")
    (tmp_path / "sub").mkdir()
    put("sub/deep.pdf")
    (tmp_path / "part=1").mkdir()
    put("part=1/deep.pdf")
    return tmp_path, put


def test_scan_folder(spark, folder):
    path, _ = folder
    found = fs.scan_folder(spark, str(path)).orderBy("file_name").collect()
    assert [(r.file_name, r.file_size_kb, r.absolute_path) for r in found] == [
        ("a.pdf", 4, f"{path}/a.pdf"), ("b.pdf", 1, f"{path}/b.pdf")
    ]
    assert str(found[0].last_modified) == "2023-11-14 22:13:20"
    assert {r.file_name for r in fs.scan_folder(spark, str(path), "*").collect()} == {"a.pdf", "b.pdf", "B.PDF"}
    assert fs.scan_folder(spark, str(path / "gone")).count() == 0


def test_listing_reads_no_contents(spark, folder):
    plan = fs.list_folder(spark, str(folder[0]))._jdf.queryExecution().executedPlan().toString()
    assert "content:binary" not in plan and "modificationTime" in plan


def test_delta_and_manifest(spark, folder):
    path, put = folder
    listing = fs.list_folder(spark, str(path))
    empty = spark.createDataFrame([], fs.MANIFEST_SCHEMA)
    known = spark.createDataFrame(
        fs.updated_manifest(empty, fs.changed_files(listing, empty)).collect(), fs.MANIFEST_SCHEMA
    )
    assert fs.changed_files(listing, known).count() == 0
    put("b.pdf", b"new", modified=1_700_000_060)
    put("a.pdf", b"older", modified=1_600_000_000)
    put("c.pdf")
    changed = fs.changed_files(fs.list_folder(spark, str(path)), known)
    assert {r.absolute_path.rsplit("/", 1)[1] for r in changed.collect()} == {"b.pdf", "c.pdf"}


def test_extract_pages(spark, folder):
    path, put = folder
    put("a.pdf", b"one\ftwo\f")
    payloads = fs.scan_folder(spark, str(path))
    pages = fs.extract_pages(spark, payloads, str(path), lambda body: body.decode().split("\f") + [None])
    rows = pages.filter("document_name = 'a.pdf'").orderBy("page").collect()
    assert [(r.page, r.total_pages, r.raw_text) for r in rows] == [(1, 4, "one"), (2, 4, "two"), (3, 4, ""), (4, 4, "")]


def test_publish_replaces_and_removes(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"))
    old = spark.createDataFrame([("a0", "a"), ("a1", "a"), ("b0", "b"), ("c0", "c")], CHUNKS)
    store.publish(old, old)
    new = spark.createDataFrame([("a9", "a")], CHUNKS)
    processed = spark.createDataFrame([("a",), ("b",)], "document_name string")
    version = store.publish(new, processed)

    def live():
        return sorted(r.chunk_id for r in store.read().collect())

    assert version == 1 and live() == ["a9", "c0"]
    # A repeated batch changes nothing.
    assert store.publish(old, old, version=1) == 1 and live() == ["a9", "c0"]
    # Earlier versions stay readable, an unfinished publish is not seen.
    assert store.read(0).count() == 4
    new.write.parquet(f"{store.root}/chunks/version=2")
    assert live() == ["a9", "c0"]
    assert store.compact() == 2 and live() == ["a9", "c0"]


def text_pages(spark, path):
    """Stands in for an extractor: pages are parted by form feeds."""

    def read(chosen):
        payloads = fs.file_payloads(chosen)
        return fs.extract_pages(spark, payloads, str(path), lambda body: body.decode().split("\f"))

    return read


def test_ingest_then_ask(spark, folder, tmp_path):
    path, put = folder
    put("a.pdf", b"SECTION 1.0 GLOVES\nWear nitrile gloves with acid.\fAcid burns skin.")
    put("b.pdf", b"Revision Date Approved by: x")
    store = ChunkStore(spark, str(tmp_path / "kb"))
    listing = lambda: fs.list_folder(spark, str(path))
    outcome = scan_and_ingest(store, listing(), text_pages(spark, path))
    assert outcome.status == "Scan completed successfully: 2/2 documents synchronized."
    receipts = {r.document_name: (r.total_pages, r.chunks_indexed) for r in outcome.receipts.collect()}
    assert receipts == {"a.pdf": (2, 2), "b.pdf": (1, 0)}
    assert {(r.document_name, r.total_pages, r.chunk_count) for r in document_catalog(store.read()).collect()} == {("a.pdf", 2, 2)}

    again = scan_and_ingest(store, listing(), text_pages(spark, path))
    assert again.status.startswith("Scan completed: Knowledge base is up to date")
    assert scan_and_ingest(store, listing(), text_pages(spark, path), manual=True).status == (
        "Manual scan completed: 0/0 documents dispatched."
    )
    forced = scan_and_ingest(store, listing(), text_pages(spark, path), force_all=True, manual=True)
    assert forced.dispatched == 2 and store.read().count() == 2

    asked = spark.createDataFrame(
        [(1, " nitrile gloves ", 4), (2, "NITRILE gloves", None), (3, "zebra", 2), (4, " ", 2)],
        "query_id bigint, query string, top_k int",
    )
    questions = distinct_questions(asked)
    assert questions.count() == 2
    contexts = question_contexts(questions, store.read()).collect()
    assert len(contexts) == 1
    citation = contexts[0].citations[0]
    assert (citation["document"], citation["page"], citation["section"]) == ("a.pdf", 1, "SECTION 1.0 GLOVES")
    assert contexts[0].context.startswith("[1] Document: a.pdf | Section: SECTION 1.0 GLOVES | Page: 1\nExcerpt: SECTION")
    assert contexts[0].context.endswith("\n")


def test_failed_file_keeps_its_document_and_is_tried_again(spark, folder, tmp_path):
    path, put = folder
    broken = {b"bad"}

    def extractor(body):
        if body in broken:
            raise ValueError("no pages")
        return body.decode().split("\f") if body != b"none" else []

    def read(chosen):
        return fs.extract_pages(spark, fs.file_payloads(chosen), str(path), extractor)

    def scan(root):
        return scan_and_ingest(root, fs.list_folder(spark, str(path)), read)

    store = ChunkStore(spark, str(tmp_path / "kb"))
    put("a.pdf", b"good")
    assert scan(store).synchronized == 2
    put("a.pdf", b"bad", 1_700_000_060)
    put("b.pdf", b"none", 1_700_000_060)
    outcome = scan(store)
    assert outcome.status == "Scan completed successfully: 1/2 documents synchronized."
    assert [(r.document_name, r.error) for r in outcome.failures.collect()] == [("a.pdf", "ValueError: no pages")]
    # The broken file's chunks stay, the one without pages loses its own.
    assert [(r.document_name, r.text) for r in store.read().collect()] == [("a.pdf", "good")]
    assert [(r.document_name, r.total_pages, r.chunks_indexed) for r in outcome.receipts.collect()] == [("b.pdf", 0, 0)]
    broken.clear()
    assert scan(store).synchronized == 1
    assert [r.text for r in store.read().collect()] == ["bad"]


def test_event_lines_skip_noise(spark, tmp_path):
    path = str(tmp_path / "lines")
    events = spark.createDataFrame(
        [("r", 0, "token", 'quote " and é\n')], "request_id string, seq bigint, type string, content string"
    )
    write_event_lines(events, path)
    spark.createDataFrame([("",), ("  ",), ("{broken",), ("[1]",), ('{"seq": 1}',)], "value string").write.mode("append").text(path)
    rows = read_event_lines(spark, path).collect()
    assert [(r.request_id, r.content) for r in rows] == [("r", 'quote " and é\n')]
