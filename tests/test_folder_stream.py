"""The folder as a source: batch listing, and a stream of what is new or changed."""

import os
import time

import pytest

from citemill.sources import files as fs
from citemill.sources.folder_stream import read_listing, stream_listing
from citemill.sources.store import ChunkStore
from citemill.streaming.poll import start_watching


@pytest.fixture
def folder(tmp_path):
    path = tmp_path / "in"
    path.mkdir()

    def put(name, body=b"x", modified=1_700_000_000):
        (path / name).write_bytes(body)
        os.utime(path / name, (modified, modified))

    return path, put


def test_batch_listing_equals_sparks_own(spark, folder):
    path, put = folder
    for name in ("a.pdf", "b [1].pdf", "c.txt"):
        put(name, b"abc")
    (path / "sub.pdf").mkdir()
    put("sub.pdf/deep.pdf")
    rows = lambda frame: sorted(map(tuple, frame.collect()))
    assert rows(read_listing(spark, str(path))) == rows(fs.list_folder(spark, str(path)))
    assert read_listing(spark, str(path / "none")).count() == 0
    assert [os.path.basename(r[0]) for r in rows(read_listing(spark, str(path), "*.txt"))] == ["c.txt"]
    # Names that Spark's own listing hides are seen.
    put("_x.pdf")
    assert any(r[0].endswith("/_x.pdf") for r in rows(read_listing(spark, str(path))))


def test_stream_brings_changes_once(spark, folder, tmp_path):
    path, put = folder
    store, seen = ChunkStore(spark, str(tmp_path / "kb")), []

    def read(chosen):
        seen.append({os.path.basename(r.absolute_path) for r in chosen.collect()})
        return fs.extract_pages(spark, fs.file_payloads(chosen), str(path), lambda body: [body.decode()])

    def run():
        time.sleep(0.1)
        query = start_watching(
            store, stream_listing(spark, str(path), settle_ms=0), read, str(tmp_path / "progress"), {"processingTime": "0 seconds"}
        )
        query.processAllAvailable()
        query.stop()

    put("a.pdf", b"one")
    put("b.pdf", b"two")
    run()
    put("a.pdf", b"changed", 1_700_000_100)
    put("old.pdf", b"moved in", 1_500_000_000)  # an old file that has just come
    run()
    run()
    assert seen[0] == {"a.pdf", "b.pdf"} and set().union(*seen[1:]) == {"a.pdf", "old.pdf"}
    assert {r.text for r in store.read().collect()} == {"changed", "two", "moved in"}
    # A new checkpoint lists all files, and the manifest knows them.
    query = start_watching(store, stream_listing(spark, str(path), settle_ms=0), read, str(tmp_path / "other"), {"processingTime": "0 seconds"})
    query.processAllAvailable()
    query.stop()
    assert store.last_version() == len(seen) - 1
