"""Answer clean-up, messages, answer events."""

from __future__ import annotations

from pyspark.sql import functions as F

from citemill.functions import answers as an
from citemill.operators.answer_log import fold_events
from citemill.registry import inputs as given
from citemill.registry.catalog import register
from citemill.session import scratch_path
from citemill.sources import event_lines as ev
from citemill.streaming.drain import arrive_in_parts, drained
from citemill.streaming.fold import fold_events_stream

CLEANED = r"""cleaned AS (
  SELECT *, regexp_replace(trim(regexp_replace(answer, '(?is)\n(?:\*\*|##|\b)?References(?:\:|\*\*|\b)?.*$', ''), ' ' || chr(9) || chr(10) || chr(13)),
                           '\[(\d+)\]', '<sup>[\1]</sup>', 'g') AS clean
  FROM answers)"""


@register(
    "p15_answer_cleanup",
    given.with_ctes("SELECT request_id, clean AS answer FROM cleaned", given.ANSWERS, CLEANED),
)
def p15(spark, folder):
    return given.answers(spark, folder).select("request_id", an.answer_cleanup(F.col("answer")).alias("answer"))


@register(
    "p16_superscript",
    given.with_ctes(
        r"SELECT request_id, regexp_replace(answer, '\[(\d+)\]', '<sup>[\1]</sup>', 'g') AS answer FROM answers",
        given.ANSWERS,
    ),
)
def p16(spark, folder):
    return given.answers(spark, folder).select("request_id", an.superscript(F.col("answer")).alias("answer"))


@register(
    "p17_citation_label",
    given.with_ctes(
        """SELECT chunk_id, '[' || (chunk_index + 1) || '] ' || coalesce(document_name, 'Document')
             || CASE WHEN coalesce(section, '') <> '' THEN ' › ' || section ELSE '' END
             || CASE WHEN coalesce(page, 0) <> 0 THEN ' › Page ' || page ELSE '' END AS label
           FROM chunks""",
        given.DOCUMENT_CHUNKS,
    ),
)
def p17(spark, folder):
    return given.document_chunks(spark, folder).select(
        "chunk_id",
        an.citation_label(
            F.col("chunk_index") + 1, F.col("document_name"), F.col("section"), F.col("page")
        ).alias("label"),
    )


@register(
    "p19_failure_answer",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'Inference engine failure: ' || props ELSE event_type END AS answer
       FROM events""",
)
def p19(spark, folder):
    error = F.when(F.col("event_type") == "error", F.col("props"))
    return given.table(spark, folder, "events").select(
        "event_id", an.failure_answer(error, F.col("event_type")).alias("answer")
    )


@register(
    "p20_response_time",
    """SELECT event_id, CAST(micros AS DOUBLE) / 1000000.0 AS seconds, printf('%.2fs', CAST(micros AS DOUBLE) / 1000000.0) AS label
       FROM (SELECT event_id, CAST(round(value * 1000) AS BIGINT) * 1000 AS micros FROM events)""",
)
def p20(spark, folder):
    start = F.col("ts").cast("timestamp")
    took = F.round(F.col("value") * 1000).cast("bigint") * 1000
    end = F.timestamp_micros(F.unix_micros(start) + took)
    timed = given.table(spark, folder, "events").select("event_id", an.response_seconds(start, end).alias("seconds"))
    return timed.withColumn("label", an.response_time_label(F.col("seconds")))


@register(
    "s13_event_sink",
    given.with_ctes("SELECT request_id, seq, type, content, full_answer FROM answer_events", given.ANSWERS, given.ANSWER_EVENTS),
)
def s13(spark, folder):
    """Events written as JSON lines and read back."""
    path = scratch_path(spark, "event-lines")
    ev.write_event_lines(given.answer_events(spark, folder), path)
    return ev.read_event_lines(spark, path).select("request_id", "seq", "type", "content", "full_answer")


@register(
    "s14_event_source",
    given.with_ctes("SELECT type, count(*) AS events FROM answer_events GROUP BY type", given.ANSWERS, given.ANSWER_EVENTS),
)
def s14(spark, folder):
    """The same lines between blank and broken ones, which are skipped."""
    lines = ev.event_lines(given.answer_events(spark, folder))
    noise = given.answers(spark, folder).select(F.explode(F.array(F.lit(" \t"), F.col("answer"))).alias("value"))
    return ev.parse_event_lines(lines.unionByName(noise)).groupBy("type").agg(F.count("*").alias("events"))


@register(
    "s15_message_append",
    """SELECT role, text AS content, CAST(NULL AS DOUBLE) AS response_time FROM conversations WHERE role <> 'assistant'
       UNION ALL SELECT role, text, turn / 4.0 FROM conversations WHERE role = 'assistant'""",
)
def s15(spark, folder):
    messages = given.table(spark, folder, "conversations").select("role", F.col("text").alias("content"), "turn")
    history = messages.filter("role <> 'assistant'").drop("turn")
    new = messages.filter("role = 'assistant'").select("role", "content", (F.col("turn") / 4.0).alias("response_time"))
    return ev.append_messages(history, new)


END = "~end"
MESSAGE_SQL = """SELECT role, text AS content, CAST(NULL AS VARCHAR) AS cited, CAST(0 AS INTEGER) AS n_citations
  FROM conversations WHERE role <> 'assistant'
  UNION ALL SELECT 'assistant', answer, request_id, 1 FROM folded"""
FOLDED = """folded AS (
  SELECT request_id,
         coalesce(arg_max(full_answer, seq) FILTER (type = 'done'), string_agg(content, '' ORDER BY seq) FILTER (type = 'token')) AS answer,
         count(*) FILTER (type = 'token') AS token_count,
         count(*) FILTER (type = 'done') > 0 AS finished
  FROM answer_events GROUP BY request_id)"""


@register(
    "a5_fold_events",
    given.with_ctes(
        "SELECT request_id, answer, token_count, finished, request_id AS cited FROM folded",
        given.ANSWERS, given.ANSWER_EVENTS, FOLDED,
    ),
)
def a5(spark, folder):
    folded = fold_events(given.answer_events(spark, folder), block_rows=64)
    return folded.withColumn("cited", F.get(F.col("citations"), F.lit(0))["document"]).drop("citations")


@register("s15_message_citations", given.with_ctes(MESSAGE_SQL, given.ANSWERS, given.ANSWER_EVENTS, FOLDED))
def s15_citations(spark, folder):
    """The history with the answers folded from their events, citations and all."""
    asked = given.table(spark, folder, "conversations").filter("role <> 'assistant'").select("role", F.col("text").alias("content"))
    answered = ev.assistant_messages(fold_events(given.answer_events(spark, folder)))
    history = ev.append_messages(asked, answered)
    cited = F.coalesce("citations", F.array().cast(history.schema["citations"].dataType))
    return history.select("role", "content", F.get(cited, F.lit(0))["document"].alias("cited"), F.size(cited).alias("n_citations"))


@register(
    "st6_stream_fold",
    given.with_ctes(
        "SELECT request_id, answer, token_count, finished FROM folded",
        given.ANSWERS, given.ANSWER_EVENTS, FOLDED,
    ),
)
def st6(spark, folder):
    """The fold over a stream of event lines in three micro-batches.

    An event happens ``seq`` milliseconds after its conversation's hour starts and
    arrives up to ten minutes late, so many tokens come after their ``done``. A last
    line moves the clock past all of them, also past the idle time of unfinished ones.
    """
    events = given.answer_events(spark, folder)
    conversation = F.split("request_id", ":")[0].cast("bigint")
    millis = F.lit(1_704_067_200_000) + conversation * 60_000 + F.col("seq")
    delay = F.pmod(F.xxhash64("request_id", "seq", "type"), F.lit(600_000))
    timed = events.withColumn("ts", F.timestamp_millis(millis)).withColumn("arrived", F.timestamp_millis(millis + delay))
    as_line = F.to_json(F.struct(*events.columns, "ts")).alias("value")
    lines = timed.select(as_line, "arrived")
    last = timed.agg(F.max("ts").alias("ts")).select(
        F.to_json(F.struct(F.lit(END).alias("request_id"), F.lit(0).alias("seq"), F.lit("token").alias("type"),
                           F.expr("ts + interval 2 days").alias("ts"))).alias("value")
    )
    stream = arrive_in_parts(lines, last, scratch_path(spark, "event-lines"), ["value"])
    parsed = ev.parse_event_lines(stream, ev.TIMED_EVENT_TYPE)
    folded = drained(fold_events_stream(parsed, lateness="15 minutes", idle_seconds=3600))
    return folded.where(F.col("request_id") != END).select("request_id", "answer", "token_count", "finished")
