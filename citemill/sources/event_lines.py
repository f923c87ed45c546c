"""Answer events as JSON lines, and the message history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citemill.functions.text import strip

CITATION_TYPE = (
    "struct<index:int,document:string,page:int,section:string,snippet:string,distance:double>"
)
EVENT_TYPE = (
    "struct<request_id:string,seq:bigint,type:string,content:string,full_answer:string,"
    f"citations:array<{CITATION_TYPE}>,context_count:int>"
)

# With the time an event happened, which the streaming fold needs.
TIMED_EVENT_TYPE = EVENT_TYPE[:-1] + ",ts:timestamp>"


def event_lines(events: DataFrame) -> DataFrame:
    """One JSON object per event row."""
    return events.select(F.to_json(F.struct(*events.columns)).alias("value"))


def write_event_lines(events: DataFrame, path: str) -> None:
    event_lines(events).write.mode("append").text(path)


def parse_event_lines(lines: DataFrame, event_type: str = EVENT_TYPE) -> DataFrame:
    """Events of the lines that hold JSON; blank and broken lines are dropped."""
    parsed = lines.filter(strip(F.col("value")) != "").select(F.from_json("value", event_type).alias("e"))
    return parsed.filter("e.type is not null").select("e.*")


def read_event_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_event_lines(spark.read.text(path))


def assistant_messages(folded: DataFrame) -> DataFrame:
    """Folded answers as history rows: role, content and the citations that came with them."""
    return folded.select(F.lit("assistant").alias("role"), F.col("answer").alias("content"), "citations")


def append_messages(history: DataFrame, new: DataFrame) -> DataFrame:
    """History with new rows added; a column one side lacks is null there."""
    return history.unionByName(new, allowMissingColumns=True)
