"""Periodic runs, hard negatives and WARC archives against brute force, exact round trips and odd inputs."""

import gzip
import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citemill.llm import hard_negatives, warc_chunks, word_runs
from citemill.session import scratch_path

FOLDER = "/root/testdata/sf0.001"


# Periodic runs
def _runs(words):
    found = set()
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > start and i - start + q >= max(6, 4 * q):
                root = words[start : start + q]
                if not any(q % d == 0 and root == root[:d] * (q // d) for d in range(1, q)):
                    found.add((start, i - start + q, q))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def _changed(doc_id, words):
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]


def _expected(doc_id, words):
    runs = _runs(words)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(words), len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def _repetitive(seed, size=None):
    rnd = random.Random(seed)
    n = size or rnd.choice([0, 3, 6, 10, 50, 200, 500])
    words = [b"w%d" % rnd.randrange(rnd.choice([1, 2, 3, 60])) for _ in range(n)]
    for _ in range(rnd.randrange(4)):
        if n:
            a = rnd.randrange(n)
            p = rnd.randrange(1, max(2, (n - a) // 4 + 1))
            for i in range(a + p, a + rnd.randrange(n - a + 1)):
                words[i] = words[i - p]
    return words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=8))
def test_runs_of_documents_side_by_side(seeds):
    words = [_repetitive(s) for s in seeds]
    assert word_runs.runs_of(words) == [_runs(w) for w in words]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b"]), max_size=60))
def test_runs_of_two_words(words):
    assert word_runs.runs_of([words]) == [_runs(words)]


def test_powers_of_a_word_have_one_period():
    for words in ([b"a"] * 300, [b"a", b"b"] * 200, [b"x"] + [b"a", b"b", b"a"] * 90, [b"y"] * 5):
        assert word_runs.runs_of([words]) == [_runs(words)]


def test_work_grows_with_length():
    """Many tiles of one word: fragments stay in proportion to the text."""
    codes = np.zeros(1 << 14, np.int64)
    hashes = word_runs.mixed(codes)
    assert sum(len(word_runs.fragments(codes, hashes, p)) for p in word_runs.octaves(len(codes))) == 1


def test_tiles_stitch_to_whole_runs(spark):
    """The tiled way, on tiles of 16 words, gives what the single tile gives."""
    texts = [b" ".join(_repetitive(s)).decode() for s in range(120)] + ["a b c " * 400, "z " * 700, None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    expected = sorted(map(str, (_expected(i, (t or "").encode().split()) for i, t in enumerate(texts))))
    for long_bytes in (-1, 300, 1 << 16):
        found = word_runs.run_summaries(docs, long_bytes=long_bytes, tile_words=16).collect()
        assert sorted(map(str, map(tuple, found))) == expected


def test_runs_query(spark):
    found = {r.doc_id: tuple(r) for r in word_runs.op11_word_runs(spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert len(found) == len(docs)
    for r in docs:
        row = _expected(r.doc_id, _changed(r.doc_id, (r.text or "").encode().split()))
        milli = None if row[4] is None else 1000 * row[4] // row[5]
        assert found[r.doc_id] == (*row, milli)
    assert sum(row[2] > 0 for row in found.values()) >= 10


def test_runs_of_odd_rows(spark, odd_docs, no_docs):
    found = word_runs.run_summaries(odd_docs).collect()
    assert len(found) == odd_docs.count() and all(r.n_words == 0 for r in found if r.doc_id in (0, 1, 2, 13))
    assert word_runs.run_summaries(no_docs).count() == 0
    assert word_runs.with_periodic_ends(odd_docs).count() == odd_docs.count()


# Hard negatives
def _vectors(n=900, seed=5):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(0, 0.2, (6, 8))
    vectors = centres[rnd.integers(0, 6, n)] + rnd.normal(0, 0.1, (n, 8))
    vectors[: n // 3] = vectors[0]  # a third of all rows are one vector
    labels = rnd.integers(0, 4, n)
    return [(int(i), [float(x) for x in v], int(k)) for i, v, k in zip(rnd.permutation(n), vectors, labels)]


def _mined(rows):
    """Plain Python: (anchor, positive, rank, negative, scores)."""
    rows = [(i, [int(np.floor(256 * x)) for x in v], k) for i, v, k in rows]
    found = set()
    for anchor, v, label in rows:
        if anchor % 50:
            continue
        scores = sorted(((-sum(x * y for x, y in zip(v, w)), i, k) for i, w, k in rows if i != anchor))
        for s, positive, _ in [r for r in scores if r[2] == label][:5]:
            fit = [(i, -t) for t, i, k in scores if k != label and 50 * -s <= 100 * -t <= 95 * -s]
            found |= {(anchor, positive, rank, i, -s, t) for rank, (i, t) in enumerate(fit[:3], 1)}
    return found


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("shard_rows,anchor_rows", [(10_000, 1000), (100, 5)])
def test_hard_negatives_equal_brute_force(spark, shard_rows, anchor_rows):
    rows = _vectors()
    as_float = [(i, [float(np.float32(x)) for x in v], k) for i, v, k in rows]
    taking_part = hard_negatives.participants(spark.createDataFrame(rows, VECTORS).repartition(4))
    found = hard_negatives.hard_negatives(taking_part, F.col("vec_id") % 50 == 0, shard_rows=shard_rows, anchor_rows=anchor_rows)
    assert {tuple(r) for r in found.collect()} == _mined(as_float)


def test_bounds_hold_and_searches_stop():
    """A cell's bound is never below a row's score, cells come in falling order, and not all are visited."""
    rnd = np.random.default_rng(1)
    centres = rnd.normal(0, 60, (40, 16))
    vectors = np.floor(centres[rnd.integers(0, 40, 6000)] + rnd.normal(0, 4, (6000, 16)))
    books = hard_negatives.fit_codebook(vectors[:, :8]), hard_negatives.fit_codebook(vectors[:, 8:])
    shard = hard_negatives.Shard(vectors, books)
    anchor = vectors[17]
    seen, before = 0, np.inf
    for rest, ranges in shard.visit(anchor):
        places, scores = shard.scores(anchor, ranges)
        assert scores.max(initial=-(10**9)) <= before + 1
        assert rest <= before
        seen, before = seen + len(places), rest
    assert seen == len(vectors)
    top = np.sort(vectors @ anchor)[::-1]
    visited = 0
    for rest, ranges in shard.visit(anchor):
        visited += sum(e - s for s, e in ranges)
        if rest < top[4]:
            break
    assert visited < len(vectors) / 2


def test_hard_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [0.5, 0.5], 1), (0, [0.5, 0.5], 1), (1, [0.4, 0.4], 1), (2, [0.35, 0.35], 2), (2, [0.35, 0.35], 2),
        (3, None, 1), (4, [0.5, None], 1), (5, [nan, 0.5], 2), (6, [inf, 0.1], 2), (7, [0.1, 0.1], None),
        (8, [0.1], 1), (None, [0.35, 0.35], 2), (None, [0.35, 0.35], 1), (50, [-0.5, -0.5], 1), (9, [], 1),
    ]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS + ", place string, at int")
    for rows_a_shard in (2, 100):
        taking_part = hard_negatives.participants(frame)
        found = hard_negatives.hard_negatives(taking_part, F.col("vec_id") % 50 == 0, shard_rows=rows_a_shard).collect()
        assert {r.anchor_id for r in found} == {0}
        # Both rows with id 0 are anchors and each other's positives; null ids lose ties.
        own = [(r.positive_id, r["rank"], r.negative_id) for r in found if r.positive_score == 2 * 128 * 128]
        assert sorted(own, key=str) == sorted([(0, 1, 2), (0, 2, 2), (0, 3, None)] * 2, key=str)
    assert hard_negatives.hard_negatives(hard_negatives.participants(frame.limit(0)), F.col("vec_id") % 50 == 0).count() == 0


# WARC
def _pages(spark):
    big = "<p>" + "Zeile äöü\r\n\r\nWARC/1.0\r\n" * 4000 + "</p>"
    rows = [
        (5, "http://a/", "x" * 100), (3, "http://b/", "x" * 100), (9, None, "x" * 100), (2, "http://c/", "x" * 99),
        (1, "http://d/", "x" * 99), (4, "http://a/\r\nb", None), (6, "http://e/", ""), (7, "http://f/", big), (8, "u", big),
        (10, "u", "é" * 70_001), (11, "u", "x" * (1 << 16)), (12, "u", "y" * ((1 << 16) + 1)), (13, "u", "\n\r\n\r\n\r\n"),
    ]
    return rows, spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, digest string, row_place int")


def _records(rows):
    first = {}
    for page, _, html in sorted(rows):
        first.setdefault(html or "", page)
    found = set()
    for page, _, html in rows:
        body = (html or "").encode()
        other = first[html or ""] if len(body) >= 100 and first[html or ""] != page else None
        found.add((page, len(body), hashlib.sha256(body).hexdigest(), "response" if other is None else "revisit", other))
    return found


@pytest.mark.parametrize("chunk_bytes", [1 << 16, 1000])
def test_archives_round_trip(spark, chunk_bytes):
    rows, pages = _pages(spark)
    found = warc_chunks.round_trip(pages.repartition(3), chunk_bytes).collect()
    assert len(found) == len(rows) and set(map(tuple, found)) == _records(rows)
    path = scratch_path(spark, "warc-test")
    warc_chunks.write_archives(pages, path, chunk_bytes)
    chunks = warc_chunks.read_chunks(spark, path, chunk_bytes).collect()
    assert max(len(c.payload) for c in chunks) <= chunk_bytes
    whole = {}
    for c in sorted(chunks, key=lambda c: c.chunk_no):
        whole[c.page_id] = whole.get(c.page_id, b"") + c.payload
        # Each row has the digest and length up to its own end.
        assert c.payload_digest == hashlib.sha256(whole[c.page_id]).hexdigest() and c.payload_bytes == len(whole[c.page_id])
    texts = {page: (html or "").encode() for page, _, html in rows}
    kinds = {c.page_id: c.record_type for c in chunks}
    assert whole == {page: b"" if kinds[page] == "revisit" else body for page, body in texts.items()}
    assert {c.page_id for c in chunks if c.last} == set(texts) and len([c for c in chunks if c.last]) == len(rows)


def test_files_are_plain_warc(spark):
    """Every file is read record by record with nothing but Content-Length; nothing is left over."""
    rows, pages = _pages(spark)
    path = scratch_path(spark, "warc-test")
    warc_chunks.write_archives(pages, path)
    folder, responses = path.removeprefix("file:"), 0
    for name in os.listdir(folder):
        if not name.endswith(".gz"):
            continue
        with gzip.open(f"{folder}/{name}") as source:
            data = source.read()
        while data:
            head, _, data = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            assert lines[0] == "WARC/1.0"
            fields = dict(x.split(": ", 1) for x in lines[1:])
            assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= fields.keys()
            size = int(fields["Content-Length"])
            assert data[size : size + 4] == b"\r\n\r\n"
            responses += fields["WARC-Type"] != "continuation"
            data = data[size + 4 :]
    assert responses == len(rows)


def test_reader_holds_one_chunk():
    """A record of another writer, fed in small pieces: what is held stays below a chunk and a piece."""
    body = os.urandom(300_000)
    head = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: %d\r\n\r\n" % len(body)
    reader, found = warc_chunks.ChunkReader(4096, True), []
    data = (head + body + b"\r\n\r\n") * 2
    for at in range(0, len(data), 500):
        found += reader.feed(data[at : at + 500])
        assert len(reader.held) < 4096 + 500
    assert b"".join(r[7] for r in found) == body * 2 and sum(r[10] for r in found) == 2
    with pytest.raises(ValueError):
        list(warc_chunks.ChunkReader(4096, True).feed(b"GARBAGE and more"))


def test_rows_that_repeat_a_page(spark):
    rows = [(1, "u", "a" * 200), (1, "u", "a" * 200), (None, "u", "a" * 200), (None, "u", None)]
    found = warc_chunks.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in found) == sorted(
        [("1", "response", None), ("1", "revisit", 1), ("None", "revisit", 1), ("None", "response", None)], key=str
    )
    assert warc_chunks.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
