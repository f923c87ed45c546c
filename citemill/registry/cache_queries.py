"""Question validation, answer cache and its replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from citemill.operators import retrieval as rt
from citemill.operators.answer_log import live_answers, prune_answers
from citemill.operators.cache_replay import cache_generations, replay_cache
from citemill.plans.questions import distinct_questions
from citemill.registry import inputs as given
from citemill.registry.catalog import register
from citemill.session import scratch_path
from citemill.streaming.drain import arrive_in_parts, drained
from citemill.streaming.replay import replay_cache_stream

LOG = (given.QUESTION_LOG,)
END_KEY = "~end"


def _keyed(spark, folder):
    return rt.with_cache_key(rt.valid_questions(given.question_log(spark, folder)))


@register(
    "p7_validate_query",
    given.with_ctes(
        """SELECT event_id, trim(query, ' ' || chr(9)) AS query, coalesce(top_k, 4) AS top_k,
             CASE WHEN trim(query, ' ' || chr(9)) = '' THEN 'blank query'
                  WHEN coalesce(top_k, 4) NOT BETWEEN 1 AND 10 THEN 'top_k out of range' END AS reason
           FROM question_log""",
        *LOG,
    ),
)
def p7(spark, folder):
    return rt.validate_questions(given.question_log(spark, folder)).select("event_id", "query", "top_k", "reason")


@register("p8_cache_key", given.with_ctes("SELECT event_id, cache_key FROM keyed_log", *LOG))
def p8(spark, folder):
    return _keyed(spark, folder).select("event_id", "cache_key")


@register(
    "p8_distinct_questions",
    given.with_ctes(
        """SELECT cache_key AS query_id, upper(any_value(query)) AS query, top_k, count(*) > 0 AS embedded
           FROM keyed_log GROUP BY cache_key, top_k""",
        *LOG,
    ),
)
def p8_distinct(spark, folder):
    """Equal questions of the log, once each and with a vector."""
    log = given.question_log(spark, folder).withColumnRenamed("event_id", "query_id")
    return distinct_questions(log).select(
        "query_id", "query", "top_k", (F.size("embedding") > 0).alias("embedded")
    )


ANSWER_TABLE = """stored AS (
  SELECT cache_key, max(ts) AS answer_ts, max(event_id) AS answer_id
  FROM (SELECT sha256(user_id || '_' || event_type) AS cache_key, ts, event_id FROM events) GROUP BY cache_key)"""


def _stored(spark, folder):
    """Latest answer per user and event type: more entries than the cache holds."""
    return (
        given.table(spark, folder, "events")
        .select(
            F.sha2(F.concat_ws("_", F.col("user_id").cast("string"), F.col("event_type")), 256).alias("cache_key"),
            "ts", "event_id",
        )
        .groupBy("cache_key")
        .agg(F.max("ts").alias("answer_ts"), F.max("event_id").alias("answer_id"))
    )


@register(
    "k4_prune_answers",
    given.with_ctes(
        """SELECT cache_key, answer_ts, answer_id FROM (
             SELECT *, row_number() OVER (ORDER BY answer_ts, cache_key) AS age, count(*) OVER () AS n FROM stored)
           WHERE n <= 500 OR age > 100""",
        ANSWER_TABLE,
    ),
)
def k4(spark, folder):
    return prune_answers(_stored(spark, folder))


FIRST_ANSWERS = """first_answers AS (
  SELECT cache_key, min(ts) AS answer_ts, arg_min(event_id, (ts, event_id)) AS answer_id
  FROM (SELECT sha256(user_id || '_' || event_type) AS cache_key, ts, event_id FROM events) GROUP BY cache_key)"""


@register(
    "j5_cached_answer_lookup",
    given.with_ctes(
        """SELECT event_id, answer_id, coalesce(date_diff('microsecond', answer_ts, ts) BETWEEN 0 AND 3599999999, false) AS hit
           FROM (SELECT event_id, ts, sha256(user_id || '_' || event_type) AS cache_key FROM events)
           LEFT JOIN first_answers USING (cache_key)""",
        FIRST_ANSWERS,
    ),
)
def j5(spark, folder):
    asked = given.table(spark, folder, "events").select(
        "event_id", "ts",
        F.sha2(F.concat_ws("_", F.col("user_id").cast("string"), F.col("event_type")), 256).alias("cache_key"),
    )
    # The first answer of each key; every later question comes after it.
    kept = asked.groupBy("cache_key").agg(F.min("ts").alias("answer_ts"), F.min_by("event_id", F.struct("ts", "event_id")).alias("answer_id"))
    return live_answers(asked, kept).select("event_id", "answer_id", "hit")


# The chain of entries per key, one recursion step per entry.
CHAIN = """chain AS (
  SELECT {keys}, min(ts) AS entry_ts FROM generations WHERE cacheable GROUP BY ALL
  UNION ALL
  SELECT {prefixed}, min(g.ts) FROM chain c JOIN generations g USING ({keys})
  WHERE g.cacheable AND g.ts >= c.entry_ts + INTERVAL 1 HOUR GROUP BY ALL),
entries AS (
  SELECT {keys}, entry_ts, min(event_id) AS writer
  FROM chain JOIN generations USING ({keys}) WHERE cacheable AND ts = entry_ts GROUP BY ALL),
replayed AS (
  SELECT g.event_id, count(e.entry_ts) > 0 AS hit
  FROM generations g LEFT JOIN entries e
    ON {matched} AND (e.entry_ts < g.ts OR (e.entry_ts = g.ts AND e.writer < g.event_id))
       AND g.ts < e.entry_ts + INTERVAL 1 HOUR
  GROUP BY g.event_id)"""

PLAIN_CHAIN = CHAIN.format(keys="cache_key", prefixed="cache_key", matched="e.cache_key = g.cache_key")
GENERATION_CHAIN = CHAIN.format(
    keys="cache_key, generation",
    prefixed="cache_key, generation",
    matched="e.cache_key = g.cache_key AND e.generation = g.generation",
)
GENERATIONS = """ingest_counts AS (
  SELECT ts, CAST(row_number() OVER (ORDER BY ts, event_id) AS BIGINT) AS seen FROM ingests),
generations AS (
  SELECT l.*, coalesce(i.seen, 0) AS generation FROM keyed_log l ASOF LEFT JOIN ingest_counts i ON l.ts >= i.ts)"""


def _recursive(query: str, *ctes: str) -> str:
    return given.with_ctes(query, *ctes).replace("WITH ", "WITH RECURSIVE ", 1)


@register(
    "st3_query_cache_replay",
    _recursive(
        "SELECT event_id, hit FROM replayed",
        *LOG, "generations AS (SELECT * REPLACE (true AS cacheable) FROM keyed_log)", PLAIN_CHAIN,
    ),
)
def st3(spark, folder):
    log = _keyed(spark, folder).withColumn("cacheable", F.lit(True))
    return replay_cache(log).select("event_id", "hit")


@register(
    "st3_busy_key_replay",
    _recursive(
        "SELECT event_id, hit FROM replayed",
        *LOG, "generations AS (SELECT * FROM keyed_log)", PLAIN_CHAIN,
    ),
)
def st3_busy(spark, folder):
    """Every key with more than 150 times goes the way meant for busy keys."""
    return replay_cache(_keyed(spark, folder), walk_rows=150).select("event_id", "hit")


@register(
    "st4_cache_invalidation",
    _recursive(
        "SELECT event_id, generation, hit FROM replayed JOIN generations USING (event_id)",
        *LOG, given.INGESTS, GENERATIONS, GENERATION_CHAIN,
    ),
)
def st4(spark, folder):
    log = cache_generations(_keyed(spark, folder), given.ingests(spark, folder))
    return replay_cache(log, ["cache_key", "generation"]).select("event_id", "generation", "hit")


@register(
    "st5_uncached_outcomes",
    _recursive(
        "SELECT event_id, cacheable, hit FROM replayed JOIN generations USING (event_id)",
        *LOG, "generations AS (SELECT * FROM keyed_log)", PLAIN_CHAIN,
    ),
)
def st5(spark, folder):
    return replay_cache(_keyed(spark, folder)).select("event_id", "cacheable", "hit")


@register(
    "st3_stream_replay",
    _recursive(
        "SELECT event_id, generation, hit FROM replayed JOIN generations USING (event_id)",
        *LOG, given.INGESTS, GENERATIONS, GENERATION_CHAIN,
    ),
)
def st3_stream(spark, folder):
    """The replay over a stream of log files, with state per key.

    Rows arrive in three micro-batches, each up to an hour out of order, so that many
    come after later ones. A last row moves the clock past all of them.
    """
    columns = ["cache_key", "generation", "event_id", "ts", "cacheable"]
    tagged = cache_generations(_keyed(spark, folder), given.ingests(spark, folder)).select(
        "cache_key", "generation", "event_id", F.col("ts").cast("timestamp").alias("ts"), "cacheable"
    )
    delay = F.pmod(F.xxhash64("event_id"), F.lit(3600))
    arrived = tagged.withColumn("arrived", F.col("ts") + F.make_dt_interval(secs=delay))
    last = tagged.agg(F.max("ts").alias("ts")).select(
        F.lit(END_KEY).alias("cache_key"), F.lit(-1).cast("bigint").alias("generation"),
        F.lit(-1).cast("bigint").alias("event_id"), F.expr("ts + interval 2 days").alias("ts"), F.lit(False).alias("cacheable"),
    )
    stream = arrive_in_parts(arrived, last, scratch_path(spark, "question-log"), columns)
    rows = drained(replay_cache_stream(stream, lateness="2 hours"))
    return rows.where(F.col("cache_key") != END_KEY).select("event_id", "generation", "hit")
