from datetime import timedelta

from test_cache_replay import START, random_log, replay

from citemill.operators.answer_log import fold_events
from citemill.sources import files as fs
from citemill.sources.event_lines import EVENT_TYPE, TIMED_EVENT_TYPE
from citemill.sources.store import ChunkStore
from citemill.streaming.fold import fold_events_stream
from citemill.streaming.poll import start_polling
from citemill.streaming.replay import replay_cache_stream

EVENTS = EVENT_TYPE.removeprefix("struct<").removesuffix(">")


def drain(stream, out, progress):
    query = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def test_replay_over_several_batches(spark, tmp_path):
    log = sorted(random_log(9, 400, 5, 40, 30), key=lambda r: (r[1], r[0]))
    schema = "event_id bigint, ts timestamp_ntz, cache_key string, cacheable boolean, generation bigint"
    source, out, progress = (str(tmp_path / name) for name in ("log", "out", "progress"))
    parts = [[(*row, 0) for row in log[start:start + 150]] for start in range(0, len(log), 150)]
    for part in [*parts, [(-1, START + timedelta(days=30), "~end", False, 0)]]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        # Each run goes on from the state the last one left.
        drain(replay_cache_stream(spark.readStream.schema(schema).parquet(source)), out, progress)
    found = {r.event_id: r.hit for r in spark.read.parquet(out).where("event_id >= 0").collect()}
    assert found == replay(log)[0]


def events():
    cited = [(1, "a.pdf", 2, "S", "x", 0.5)]
    last = [(1, "b.pdf", 2, "S", "x", 0.5)]
    rows = [("r1", 0, "citations", None, None, cited, 1)]
    rows += [("r1", i, "token", f"t{i} ", None, None, None) for i in range(1, 40)]
    rows += [("r1", 40, "done", None, "final", last, None)]
    rows += [("r2", 1, "token", "a", None, None, None), ("r2", 2, "token", "b", None, None, None)]
    rows += [("r3", 0, "citations", None, None, cited, 1), ("r3", 1, "token", "c", None, None, None),
             ("r3", 2, "done", None, None, None, None)]
    return rows


def test_fold_events(spark):
    for block in (1, 7, 512):
        rows = {r.request_id: r for r in fold_events(spark.createDataFrame(events(), EVENTS), block).collect()}
        assert (rows["r1"].answer, rows["r1"].token_count, rows["r1"].citations[0]["document"]) == ("final", 39, "b.pdf")
        assert (rows["r2"].answer, rows["r2"].citations, rows["r2"].finished) == ("ab", None, False)
        assert (rows["r3"].answer, rows["r3"].citations[0]["document"]) == ("c", "a.pdf")


def test_fold_stream_over_several_batches(spark, tmp_path):
    source, out, progress = (str(tmp_path / name) for name in ("events", "out", "progress"))
    rows = [(*row, START + timedelta(seconds=row[1])) for row in events()]
    timed = TIMED_EVENT_TYPE.removeprefix("struct<").removesuffix(">")
    schema = spark.createDataFrame([], timed).schema
    end = [("~end", 0, "done", None, None, None, None, START + timedelta(days=1))]
    for part in (rows[20:30], rows[:20] + rows[41:44], rows[30:41] + rows[44:], end):
        spark.createDataFrame(part, timed).coalesce(1).write.mode("append").parquet(source)
        drain(fold_events_stream(spark.readStream.schema(schema).parquet(source)), out, progress)
    found = {r.request_id: (r.answer, r.token_count, r.finished) for r in spark.read.parquet(out).collect()}
    found.pop("~end", None)
    assert found == {"r1": ("final", 39, True), "r2": ("ab", 2, False), "r3": ("c", 1, True)}


def test_polling_takes_new_and_changed_files_once(spark, tmp_path):
    import os

    folder = tmp_path / "in"
    folder.mkdir()

    def put(name, body, modified):
        (folder / name).write_bytes(body)
        os.utime(folder / name, (modified, modified))

    store = ChunkStore(spark, str(tmp_path / "kb"))
    outcomes = []

    def tick():
        start_polling(
            store,
            lambda: fs.list_folder(spark, str(folder)),
            lambda chosen: fs.extract_pages(
                spark, fs.file_payloads(chosen), str(folder), lambda body: body.decode().split("\f")
            ),
            str(tmp_path / "progress"),
            trigger={"availableNow": True},
            on_scan=lambda batch, outcome: outcomes.append((batch, outcome.dispatched)),
        ).awaitTermination()

    put("a.pdf", b"first", 1_700_000_000)
    put("b.pdf", b"second", 1_700_000_000)
    tick()
    tick()
    put("a.pdf", b"changed", 1_700_000_100)
    put("c.pdf", b"third", 1_700_000_000)
    tick()
    assert outcomes == [(0, 2), (1, 0), (2, 2)]
    assert {r.text for r in store.read().collect()} == {"changed", "second", "third"}
