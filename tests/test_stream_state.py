"""State of the streams goes by keys and slices, not by generations or requests."""

import json
from datetime import timedelta

import numpy as np
from test_cache_replay import START
from test_streaming_order import END, LOG, state_rows, stream

from citemill.operators.answer_log import fold_events
from citemill.operators.cache_replay import replay_cache
from citemill.sources.event_lines import TIMED_EVENT_TYPE
from citemill.streaming.fold import fold_events_stream
from citemill.streaming.replay import _ENTRY, _ROW, label_generations, label_rows, replay_cache_stream


def run(found, path):
    query = (
        found.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def test_many_generations_share_their_state(spark, tmp_path):
    """400 generations of two keys: the same labels as in batch, and at most 16 blocks a key and micro-batch held."""
    log = [(i, START + timedelta(seconds=40 * i), f"k{i % 2}", i % 5 != 0, i // 6) for i in range(2400)]
    parts = [log[1::2], log[0::2]]
    found = replay_cache_stream(stream(spark, str(tmp_path / "log"), parts, LOG), lateness="30 hours")
    run(found, str(tmp_path))
    assert spark.read.schema(found.schema).parquet(str(tmp_path / "out")).count() == 0
    assert 0 < state_rows(spark, str(tmp_path / "progress"), "pending") <= 2 * 16 * len(parts)
    spark.createDataFrame([END], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    run(found, str(tmp_path))
    rows = spark.read.parquet(str(tmp_path / "out")).where("event_id >= 0").collect()
    batch = replay_cache(spark.createDataFrame(log, LOG), ["cache_key", "generation"]).collect()
    assert len(rows) == len(log)
    assert {r.event_id: (r.generation, r.hit) for r in rows} == {r.event_id: (r.generation, r.hit) for r in batch}


def test_rows_without_generation_or_time_come_out(spark, tmp_path):
    log = [(1, START, "k", True, None), (2, START + timedelta(seconds=5), "k", True, None), (3, None, "k", True, 7)]
    found = replay_cache_stream(stream(spark, str(tmp_path / "log"), [log, [END]], LOG))
    run(found, str(tmp_path))
    rows = {r.event_id: (r.generation, r.hit, r.late) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows[1] == (None, False, False) and rows[2] == (None, True, False) and rows[3] == (7, None, True)


def test_generations_labelled_together_equal_each_alone():
    rng = np.random.default_rng(3)
    for _ in range(100):
        rows = np.empty(60, _ROW)
        rows["generation"] = np.sort(rng.integers(0, 8, 60))
        rows["ts_us"], rows["event_id"] = rng.integers(50, 400, 60), np.arange(60)
        rows["cacheable"] = rng.random(60) < 0.4
        rows = rows[np.lexsort((rows["ts_us"], rows["generation"]))]
        before = np.array([(2, 20), (5, 49), (30, 40)], _ENTRY)
        hits, left = label_generations(rows, before, 100)
        known, expected = dict(before.tolist()), []
        for generation in np.unique(rows["generation"]):
            part = rows[rows["generation"] == generation]
            alone, now = label_rows(part["ts_us"], part["cacheable"], known.pop(int(generation), None), 100)
            expected += alone.tolist()
            if now is not None:
                known[int(generation)] = now
        assert hits.tolist() == expected and dict(left.tolist()) == known


def test_many_requests_share_their_state(spark, tmp_path):
    """600 requests over two micro-batches: the same answers as in batch from a few buckets of state."""
    fields = TIMED_EVENT_TYPE.removeprefix("struct<").removesuffix(">")
    rows = []
    for i in range(600):
        at = START + timedelta(seconds=i)
        rows.append((f"r{i}", 0, "citations", None, None, [(1, f"{i}.pdf", 2, "S", "x", 0.5)], 1, at))
        rows += [(f"r{i}", n, "token", None if n == 3 and i % 7 == 0 else f"{i}.{n} ", None, None, None, at) for n in range(1, 5)]
        if i % 2:
            rows.append((f"r{i}", 5, "done", None, None if i % 3 else f"final {i}", None, None, at))
    rows.append((None, 1, "token", "unnamed", None, None, None, START))
    source = str(tmp_path / "events")
    found = fold_events_stream(stream(spark, source, [rows[1::2], rows[0::2]], fields), lateness="30 minutes", buckets=8)
    run(found, str(tmp_path))
    assert 0 < state_rows(spark, str(tmp_path / "progress"), "blocks") <= 8 * 2
    assert 0 < state_rows(spark, str(tmp_path / "progress"), "said") <= 8
    end = [("~end", 0, "done", None, None, None, None, START + timedelta(days=1))]
    spark.createDataFrame(end, fields).coalesce(1).write.mode("append").parquet(source)
    run(found, str(tmp_path))
    out = spark.read.parquet(str(tmp_path / "out")).where("request_id is null or request_id <> '~end'").collect()
    got = {r.request_id: (r.answer, r.token_count, r.finished, json.loads(r.citations)[0]["document"] if r.citations else None) for r in out}
    batch = fold_events(spark.createDataFrame(rows, fields)).collect()
    ended = {r[0] for r in rows if r[2] == "done"}
    want = {r.request_id: (r.answer, r.token_count, r.request_id in ended, r.citations[0].document if r.citations else None) for r in batch}
    assert len(out) == 601 and not any(r.late_events for r in out)
    assert got == want
