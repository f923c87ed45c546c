"""The store's logs: cost of a change, pruning, lookups, overlapping writers, compaction and vacuum."""

import os

import pytest
from pyspark.sql import functions as F

from citemill.plans.ingest import scan_and_ingest
from citemill.sources import files as fs
from citemill.sources.deltas import DeltaLog
from citemill.sources.store import ChunkStore

CHUNKS = "chunk_id string, document_name string, chunk_index bigint"


def rows(spark, *chunks):
    return spark.createDataFrame([(c, d, i) for i, (c, d) in enumerate(chunks)], CHUNKS)


def names(spark, *documents):
    return spark.createDataFrame([(d,) for d in documents], "document_name string")


def versions_scanned(frame):
    return {int(f.split("version=")[1].split("/")[0]) for f in frame.inputFiles() if "version=" in f}


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def store(spark, tmp_path):
    return ChunkStore(spark, str(tmp_path / "store"))


def live(store):
    return sorted(r.chunk_id for r in store.read().collect())


def test_dead_versions_are_not_scanned(spark, store):
    store.publish(rows(spark, ("a0", "a"), ("b0", "b")), names(spark, "a", "b"))
    store.publish(rows(spark, ("a1", "a"), ("c1", "c")), names(spark, "a", "c"))
    store.publish(rows(spark, ("b2", "b")), names(spark, "b"))
    # Version 0 has no live document, versions 1 and 2 have nothing else: no join either.
    assert live(store) == ["a1", "b2", "c1"] and versions_scanned(store.read()) == {1, 2}
    assert "Join" not in plan(store.read())
    store.publish(rows(spark, ("c3", "c")), names(spark, "c"))
    assert live(store) == ["a1", "b2", "c3"] and store.live_versions() == {1: False, 2: True, 3: True}
    assert versions_scanned(store.read(0)) == {0}


def test_a_change_writes_what_it_brings(spark, store):
    many = [f"d{i}" for i in range(500)]
    store.publish(rows(spark, *((n, n) for n in many)), names(spark, *many))
    store.publish(rows(spark, ("x", "d7")), names(spark, "d7"))
    assert store.live_log.sizes([0, 1]) == {0: 500, 1: 1}
    store.write_manifest(spark.createDataFrame([("/a", 1), ("/b", 1)], fs.MANIFEST_SCHEMA))
    number = store.write_manifest(spark.createDataFrame([("/a", 0)], fs.MANIFEST_SCHEMA))
    assert store.manifest_log.sizes([number]) == {1: 1}
    assert {tuple(r) for r in store.manifest().collect()} == {("/a", 0), ("/b", 1)}


def test_null_names_are_documents(spark, store):
    store.publish(rows(spark, ("n0", None), ("a0", "a")), names(spark, None, "a"))
    assert live(store) == ["a0", "n0"]
    store.publish(rows(spark, ("n1", None)), names(spark, None))
    assert live(store) == ["a0", "n1"]
    assert [r.chunk_id for r in store.lookup(None).collect()] == ["n1"]
    store.compact()
    assert live(store) == ["a0", "n1"]


def test_publish_without_chunks(spark, store):
    store.publish(rows(spark, ("a0", "a")), names(spark, "a"))
    store.publish(rows(spark).limit(0), names(spark, "a"))
    assert live(store) == [] and store.read().columns == ["chunk_id", "document_name", "chunk_index", "version"]
    with pytest.raises(FileNotFoundError):
        ChunkStore(spark, store.root + "-none").read()


def test_overlapping_writers_lose_nothing(spark, store, monkeypatch):
    """A publish that starts first and ends last keeps its own folder and loses only to a later number."""
    store.publish(rows(spark, ("a0", "a"), ("b0", "b")), names(spark, "a", "b"))
    slow = store.live_log.claim()
    assert store.publish(rows(spark, ("a2", "a")), names(spark, "a")) == slow + 1
    monkeypatch.setattr(store.live_log, "claim", lambda: slow)
    store.publish(rows(spark, ("a1", "a"), ("b1", "b")), names(spark, "a", "b"))
    assert live(store) == ["a2", "b1"]


def test_compaction_does_not_undo_an_overlapping_publish(spark, store):
    store.publish(rows(spark, ("a0", "a"), ("b0", "b"), ("c0", "c")), names(spark, "a", "b", "c"))
    store.publish(rows(spark, ("c1", "c")), names(spark, "c"))
    started = store.live_log.claim()  # a publish of b takes its number and goes on slowly
    assert store.compact() == started + 1
    assert versions_scanned(store.read()) == {1, started + 1}
    other = ChunkStore(spark, store.root)
    other.live_log.claim = lambda: started
    other.publish(rows(spark, ("b9", "b")), names(spark, "b"))
    assert live(store) == ["a0", "b9", "c1"]


def test_vacuum_keeps_what_is_read_and_what_is_young(spark, store):
    for i in range(3):
        store.publish(rows(spark, (f"a{i}", "a"), (f"b{i}", "b")), names(spark, "a", "b") if i < 2 else names(spark, "a"))
    assert store.vacuum(3600) == [] and versions_scanned(store.read(0)) == {0}
    assert store.vacuum(0) == [0]
    assert live(store) == ["a2", "b1"]
    assert sorted(os.listdir(f"{store.root}/chunks")) == ["version=1", "version=2"]
    with pytest.raises(FileNotFoundError):
        store.read(0)
    assert store.publish(rows(spark, ("z", "z")), names(spark, "z")) == 3 and live(store) == ["a2", "b1", "z"]
    # Rows of a version whose delta was vacuumed are still told apart from dead ones.
    assert store.compact() == 4 and live(store) == ["a2", "b1", "z"]


def test_log_folds_and_waits_for_open_changes(spark, tmp_path):
    log = DeltaLog(spark, str(tmp_path / "log"), "k string, value int", "k")
    put = lambda n, *pairs: log.append(spark.createDataFrame(list(pairs), "k string, value int"), n, fold_after=3)
    now = lambda: {r.k: r.value for r in log.current().collect()}
    first, late = log.claim(), log.claim()
    put(first, ("a", 1), ("b", 1))
    for value in (2, 3, 4):
        put(log.claim(), ("a", value))
    assert log.bases() == [0] and now() == {"a": 4, "b": 1}
    put(late, ("a", 9), ("b", 9))  # older than what came after it
    assert now() == {"a": 4, "b": 9}
    assert log.fold() == 4 and now() == {"a": 4, "b": 9}
    assert log.vacuum(0) == 6 and now() == {"a": 4, "b": 9} and log.numbers() == []
    with pytest.raises(RuntimeError):
        put(2, ("a", 0))
    assert log.claim() == 5


def test_lookup_opens_few_row_groups(spark, tmp_path):
    """Rows the scan hands on, after row groups were refused by statistics and filters, of one version's folder."""
    store = ChunkStore(spark, str(tmp_path / "store"))
    spark.conf.set("spark.sql.parquet.enableVectorizedReader", "true")
    many = spark.range(200_000).select(
        F.col("id").cast("string").alias("chunk_id"),
        F.concat(F.lit("doc"), F.pmod(F.xxhash64("id"), F.lit(20_000)).cast("string")).alias("document_name"),
        F.col("id").alias("chunk_index"),
        F.sha2(F.col("id").cast("string"), 512).alias("text"),
    )
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("parquet.block.size", str(256 * 1024))
    hadoop.set("parquet.page.size", str(16 * 1024))
    try:
        store.publish(many, many)
    finally:
        hadoop.unset("parquet.block.size")
        hadoop.unset("parquet.page.size")
    store.publish(many.limit(0), names(spark, "doc5"))
    found = store.lookup("doc77")
    expected = many.where("document_name = 'doc77'").count()
    assert found.count() == expected and "PushedFilters: [IsNotNull(document_name), EqualTo(document_name,doc77)]" in plan(found)
    result = store.lookup("doc77")
    result.collect()
    read = _scan_rows(result._jdf.queryExecution().executedPlan())
    assert expected <= read < 30_000
    assert versions_scanned(found) == {0} and store.lookup("doc5").count() == 0 and store.lookup("none").count() == 0


def _scan_rows(node):
    """Output rows of the scans below a plan node."""
    if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        node = node.executedPlan()
    total, children = 0, node.children()
    if "Scan" in node.getClass().getSimpleName():
        total += node.metrics().get("numOutputRows").get().value()
    return total + sum(_scan_rows(children.apply(i)) for i in range(children.size()))


@pytest.fixture
def folder(tmp_path):
    path = tmp_path / "in x%20[1]"
    path.mkdir()

    def put(name, body=b"x", modified=1_700_000_000):
        (path / name).write_bytes(body)
        os.utime(path / name, (modified, modified))

    return path, put


def test_only_chosen_files_are_opened(spark, folder, tmp_path):
    """An unchanged file that can no longer be read does not stop a scan."""
    path, put = folder
    for name in ("a.pdf", "b é%.pdf", "c,d.pdf", "e [1].pdf"):
        put(name, name.encode())
    listing = fs.list_folder(spark, str(path))
    payloads = fs.file_payloads(listing).where("file_name <> 'a.pdf'")
    payloads = spark.createDataFrame(payloads.collect(), payloads.schema)
    wanted = fs.chosen_contents(spark, payloads, str(path))
    os.remove(path / "a.pdf")  # listed, and gone: opening it would fail
    assert {(r.file_name, bytes(r.content).decode()) for r in wanted.collect()} == {(n, n) for n in ("b é%.pdf", "c,d.pdf", "e [1].pdf")}
    # In parts of one path the same files are read.
    parts = fs.chosen_contents(spark, payloads, str(path), at_once=1)
    assert {r.file_name for r in parts.collect()} == {"b é%.pdf", "c,d.pdf", "e [1].pdf"}
    assert fs.chosen_contents(spark, payloads.limit(0), str(path)).count() == 0
    assert fs.chosen_contents(spark, payloads, str(path / "none")).count() == 0


def test_listing_does_not_walk_subfolders(spark, folder):
    path, put = folder
    put("a.pdf")
    (path / "sub").mkdir()
    put("sub/deep.pdf")
    (path / "b=1.pdf").mkdir()
    put("b=1.pdf/deep.pdf")
    assert [r.absolute_path for r in fs.list_folder(spark, str(path)).collect()] == [f"{path}/a.pdf"]
    assert fs.list_folder(spark, str(path), "*.txt").count() == 0


def test_deferred_aborted_and_failed_scans(spark, folder, tmp_path):
    path, put = folder
    put("a.pdf", b"one")
    store = ChunkStore(spark, str(tmp_path / "kb"))

    def read(chosen):
        return fs.extract_pages(spark, fs.file_payloads(chosen), str(path), lambda body: [body.decode()])

    def scan(**options):
        return scan_and_ingest(store, fs.list_folder(spark, str(path)), read, **options)

    assert scan(healthy=lambda: False).status == "Scan deferred: Python AI engine is currently unreachable."
    assert scan(healthy=lambda: False, manual=True).status == "Manual scan aborted: Python AI engine is offline."
    assert store.last_version() == -1
    assert scan().status == "Scan completed successfully: 1/1 documents synchronized."
    put("b.pdf", b"two")
    outcome = scan(manual=True)
    assert outcome.status == "Manual scan completed: 1/1 documents dispatched."
    # Each scan wrote what it took, and the receipts are of its own documents.
    assert outcome.version == 1 and store.live_log.sizes([0, 1]) == {0: 1, 1: 1}
    assert [r.document_name for r in outcome.receipts.collect()] == ["b.pdf"]
    assert store.manifest_log.sizes([0, 1]) == {0: 1, 1: 1} and store.manifest().count() == 2


def test_a_failed_tick_is_told_and_the_next_goes_on(spark, folder, tmp_path):
    from citemill.streaming.poll import start_polling

    path, put = folder
    put("a.pdf", b"one")
    store, told, fail = ChunkStore(spark, str(tmp_path / "kb")), [], [True]

    def listing():
        if fail.pop() if fail else False:
            raise OSError("no such share")
        return fs.list_folder(spark, str(path))

    def read(chosen):
        return fs.extract_pages(spark, fs.file_payloads(chosen), str(path), lambda body: [body.decode()])

    for _ in range(2):
        start_polling(
            store, listing, read, str(tmp_path / "progress"), trigger={"availableNow": True},
            on_scan=lambda batch, outcome: told.append(outcome.status),
        ).awaitTermination()
    assert told == ["Error during scheduled scan: no such share", "Scan completed successfully: 1/1 documents synchronized."]
