"""Streams whose rows come out of order and late; state that goes away."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_cache_replay import START, random_log, replay

from citemill.operators.answer_log import fold_events
from citemill.sources.event_lines import TIMED_EVENT_TYPE
from citemill.streaming.drain import drained
from citemill.streaming.fold import fold_events_stream
from citemill.streaming.replay import label_rows, replay_cache_stream

LOG = "event_id bigint, ts timestamp, cache_key string, cacheable boolean, generation bigint"
END = (-1, START + timedelta(days=300), "~end", False, 0)


def stream(spark, path, parts, schema):
    """One file a part, one part a micro-batch."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    typed = spark.createDataFrame([], schema).schema
    return spark.readStream.schema(typed).option("maxFilesPerTrigger", 1).parquet(path)


def test_labels_equal_the_rule():
    rng = random.Random(7)
    for _ in range(200):
        log = random_log(rng.randrange(10**6), rng.randrange(40), 1, 8, 600)
        log = sorted(((e, t, "k", c) for e, t, _, c in log), key=lambda r: (r[1], r[0]))
        times = np.array([int((t - START).total_seconds()) for _, t, _, _ in log], np.int64)
        hits, written = label_rows(times, np.array([c for *_, c in log], bool), None, 3600)
        expected = replay(log)[0]
        assert [bool(h) for h in hits] == [expected[e] for e, *_ in log]
        assert written is None or written in times


def test_shuffled_arrival_equals_batch(spark, tmp_path):
    """Rows up to two hours out of order over three micro-batches come out as the batch labels them."""
    log = random_log(3, 500, 4, 30, 60)
    rng = random.Random(1)
    arrival = sorted(log, key=lambda r: r[1] + timedelta(seconds=rng.randrange(7200)))
    parts = [[(*r, 0) for r in arrival[i * 167 : (i + 1) * 167]] for i in range(3)]
    assert max(r[1] for r in parts[0]) > min(r[1] for r in parts[1])
    replayed = drained(replay_cache_stream(stream(spark, str(tmp_path / "log"), [*parts, [END]], LOG), lateness="2 hours"))
    rows = replayed.where("event_id >= 0").collect()
    assert not any(r.late for r in rows)
    assert {r.event_id: r.hit for r in rows} == replay(log)[0] and len(rows) == len(log)


def test_late_rows_come_out_marked(spark, tmp_path):
    at = lambda seconds: START + timedelta(seconds=seconds)
    parts = [
        [(1, at(0), "k", True, 0), (2, at(20_000), "k", True, 0)],
        [(3, at(21_000), "k", True, 0), (4, at(16_000), "k", True, 0)],
        [(5, at(100), "k", True, 0), (6, at(17_500), "k", True, 0)],
        [END],
    ]
    rows = drained(replay_cache_stream(stream(spark, str(tmp_path / "log"), parts, LOG), lateness="1 hour"))
    found = {r.event_id: (r.hit, r.late) for r in rows.where("event_id > 0").collect()}
    # Row 4 came behind the watermark of its micro-batch (16,400), and so did row 5; row 6 did not and is put before row 2.
    assert found == {
        1: (False, False), 2: (True, False), 3: (True, False), 4: (None, True), 5: (None, True), 6: (False, False)
    }


def _events(request, ts, *rows):
    cited = [(1, "a.pdf", 2, "S", "x", 0.5)]
    return [
        (request, seq, kind, content, answer, cited if kind == "citations" else None, 1, START + timedelta(seconds=ts + seq))
        for seq, kind, content, answer in rows
    ]


def state_rows(spark, checkpoint, name):
    reader = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name)
    return reader.load().count()


def test_tokens_after_done_are_counted_and_state_goes(spark, tmp_path):
    done = _events("r1", 0, (0, "citations", None, None), (1, "token", "a ", None), (4, "done", None, "final"))
    after = _events("r1", 0, (2, "token", "b ", None), (3, "token", "c", None))
    plain = _events("r2", 0, (3, "done", None, None), (2, "token", "two", None)) + _events("r2", 0, (1, "token", "one ", None))
    idle = _events("r3", 0, (2, "token", "y", None), (1, "token", "x", None))
    late = _events("r1", 0, (9, "token", "late", None))
    end = [("~end", 0, "done", None, None, None, 1, START + timedelta(days=1))]
    beyond = [("~end2", 0, "done", None, None, None, 1, START + timedelta(days=2))]
    # The clock moves with one micro-batch, requests come out with the next.
    parts = [done + plain[:1] + idle[:1], after + plain[1:] + idle[1:], end, end, late, beyond]
    fields = TIMED_EVENT_TYPE.removeprefix("struct<").removesuffix(">")
    events = stream(spark, str(tmp_path / "events"), parts, fields)
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    query = (
        fold_events_stream(events, lateness="1 minute", idle_seconds=600)
        .writeStream.format("parquet").option("path", out).option("checkpointLocation", progress)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = spark.read.parquet(out).where("request_id not like '~%'").collect()
    found = sorted((r.request_id, r.answer, r.token_count, r.finished, r.late_events) for r in rows if not r.late_events)
    batch = fold_events(spark.createDataFrame([e for part in parts[:2] for e in part], fields))
    assert found == [("r1", "final", 3, True, 0), ("r2", "one two", 2, True, 0), ("r3", "xy", 2, False, 0)]
    assert {(r.request_id, r.answer, r.token_count) for r in batch.collect()} == {f[:3] for f in found}
    assert [(r.request_id, r.late_events) for r in rows if r.late_events] == [("r1", 1)]
    # Only the request that moved the clock last is still held.
    assert state_rows(spark, progress, "blocks") == 0 and state_rows(spark, progress, "said") <= 1
