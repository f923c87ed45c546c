import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from citemill.operators.answer_log import prune_answers
from citemill.operators.cache_replay import cache_generations, replay_cache

START = datetime(2024, 1, 1)


def replay(log, ingests=()):
    """The rule, one row after another."""
    entries, hits, seen = {}, {}, {}
    for event, at, key, cacheable in sorted(log, key=lambda row: (row[1], row[0])):
        generation = sum(t <= at for t in ingests)
        slot = (key, generation)
        hit = slot in entries and at - entries[slot] < timedelta(hours=1)
        if not hit:
            entries.pop(slot, None)
            if cacheable:
                entries[slot] = at
        hits[event], seen[event] = hit, generation
    return hits, seen


def frame(spark, log):
    return spark.createDataFrame(log, "event_id bigint, ts timestamp_ntz, cache_key string, cacheable boolean")


def random_log(seed, n, keys, span_hours, step_seconds):
    rng = random.Random(seed)
    steps = span_hours * 3600 // step_seconds
    return [
        (
            i,
            START + timedelta(seconds=step_seconds * rng.randrange(steps)),
            # The first key holds a third of all rows.
            "k0" if rng.random() < 0.34 else f"k{rng.randrange(keys)}",
            rng.random() < 0.8,
        )
        for i in range(n)
    ]


@pytest.mark.parametrize("walk_rows", [10_000, 5, 0])
@pytest.mark.parametrize("seed, step", [(1, 1), (2, 900)])
def test_replay_equals_row_by_row(spark, walk_rows, seed, step):
    log = random_log(seed, 700, 8, 60, step)
    found = replay_cache(frame(spark, log), walk_rows=walk_rows).collect()
    assert {row.event_id: row.hit for row in found} == replay(log)[0]


@pytest.mark.parametrize("batch_rows", [1, 7, 40])
def test_walk_goes_on_across_arrow_batches(spark, batch_rows):
    log = random_log(3, 500, 6, 50, 30)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch_rows)
    try:
        found = replay_cache(frame(spark, log)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {row.event_id: row.hit for row in found} == replay(log)[0]


@pytest.mark.parametrize("walk_rows", [10_000, 0])
def test_gap_of_exactly_one_ttl_is_a_miss_and_hits_do_not_extend(spark, walk_rows):
    seconds = [0, 1800, 3599, 3600, 3601, 7199, 7200, 20000]
    log = [(i, START + timedelta(seconds=s), "k", True) for i, s in enumerate(seconds)]
    found = replay_cache(frame(spark, log), walk_rows=walk_rows).collect()
    assert [r.hit for r in sorted(found)] == [False, True, True, False, True, True, False, False]


def test_uncacheable_miss_leaves_no_entry(spark):
    log = [(1, START, "k", False), (2, START, "k", True), (3, START, "k", False), (4, START + timedelta(minutes=1), "k", False)]
    found = {r.event_id: r.hit for r in replay_cache(frame(spark, log)).collect()}
    assert found == {1: False, 2: False, 3: True, 4: True}


@pytest.mark.parametrize("walk_rows", [10_000, 3])
def test_ingest_empties_the_cache(spark, walk_rows):
    log = random_log(5, 600, 4, 30, 60)
    ingests = [START + timedelta(hours=h, minutes=m) for h, m in [(1, 0), (1, 0), (4, 30), (4, 31), (20, 0)]]
    ingested = spark.createDataFrame([(t,) for t in ingests], "ts timestamp_ntz")
    tagged = cache_generations(frame(spark, log), ingested, salts=3)
    found = replay_cache(tagged, ["cache_key", "generation"], walk_rows=walk_rows).collect()
    hits, seen = replay(log, ingests)
    assert {r.event_id: r.generation for r in found} == seen
    assert {r.event_id: r.hit for r in found} == hits


def test_no_ingest_means_generation_zero(spark):
    log = frame(spark, random_log(6, 50, 3, 9, 60))
    none = spark.createDataFrame([], "ts timestamp_ntz")
    assert cache_generations(log, none).select(F.max("generation")).first()[0] == 0


@pytest.mark.parametrize("stored, left", [(500, 500), (501, 401), (50, 50)])
def test_prune_answers(spark, stored, left):
    answers = spark.range(stored).select(
        F.col("id").cast("string").alias("cache_key"), F.timestamp_seconds(stored - F.col("id")).alias("answer_ts")
    )
    kept = prune_answers(answers)
    assert kept.count() == left
    if left < stored:
        assert kept.agg(F.min("answer_ts")).first() == answers.orderBy("answer_ts").offset(100).select("answer_ts").first()
