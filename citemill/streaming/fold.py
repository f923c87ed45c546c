"""Answer events folded as they stream in.

A request comes out when the watermark has passed its ``done`` event, so that events
which arrived after it are counted too; one without a ``done`` comes out unfinished
when it has been idle for a time. Either way its state goes. Events behind that come
out as late counts, and no state is kept for them for longer than the idle time.

State and timers are held for a bucket of requests, and a call works on all of its
events at once: what a micro-batch costs beyond its events goes by buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ANSWER_SCHEMA = (
    "request_id string, answer string, token_count bigint, citations string, finished boolean, late_events bigint"
)
BUCKETS = 256
_BLOCK_ROWS = 1 << 15
_TOKEN = pa.schema({"request_id": pa.string(), "seq": pa.int64(), "content": pa.string()})
_SAID = pa.schema(
    {
        "request_id": pa.string(), "done_seq": pa.int64(), "answer": pa.string(), "cited_seq": pa.int64(),
        "citations": pa.string(), "due_ms": pa.int64(), "last_ms": pa.int64(),
    }
)
_NULLABLE = {pa.int64(): pd.Int64Dtype(), pa.string(): pd.StringDtype()}


def _packed(rows: pd.DataFrame, schema: pa.Schema) -> bytes:
    table = pa.Table.from_pandas(rows[schema.names], schema, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(blocks: list[bytes], schema: pa.Schema) -> pd.DataFrame:
    tables = [pa.ipc.open_stream(block).read_all() for block in blocks]
    return pa.concat_tables([schema.empty_table(), *tables]).to_pandas(types_mapper=_NULLABLE.get)


def _typed(rows: pd.DataFrame) -> pd.DataFrame:
    """Columns that hold nulls as nulls, whatever a batch of them looks like."""
    kinds = {name: pd.Int64Dtype() for name in ("seq", "ts_ms")}
    return rows.astype({name: kinds.get(name, pd.StringDtype()) for name in rows.columns if name != "bucket"})


class AnswerFold(StatefulProcessor):
    """Per bucket of requests: blocks of tokens, one per micro-batch, and what the other events said.

    Blocks are appended and read only when a request of the bucket comes out.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getListState("blocks", "tokens binary")
        self.said = handle.getValueState("said", "requests binary")

    def _held(self) -> pd.DataFrame:
        return _unpacked([self.said.get()[0]] if self.said.exists() else [], _SAID)

    def _ends(self, said: pd.DataFrame) -> pd.Series:
        """When each request comes out, in milliseconds."""
        return said["due_ms"].fillna(said["last_ms"] + self.idle_ms)

    @staticmethod
    def _newest(rows: pd.DataFrame, seq: str, first: bool) -> pd.DataFrame:
        """Each request's row with the greatest ``seq``; of equal ones the first or last."""
        ordered = rows.sort_values(seq, kind="stable", ascending=not first, na_position="last" if first else "first")
        return ordered.drop_duplicates("request_id", keep="first" if first else "last")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        events = _typed(pd.concat(list(rows), ignore_index=True))
        held = self._held()
        # A request that is not held and whose events all lie behind has come out before.
        behind = (events["ts_ms"] < passed).fillna(False).astype(bool)
        gone = behind.groupby(events["request_id"], dropna=False).transform("all") & ~events["request_id"].isin(held["request_id"])
        if gone.any():
            late = events[gone].groupby("request_id", dropna=False).size()
            yield self._rows(late.index, None, 0, None, False, late.to_numpy())
            events = events[~gone]
        if not len(events):
            return
        tokens = events[events["type"] == "token"]
        if len(tokens):
            tokens = tokens.assign(content=tokens["content"].fillna(""))
            blocks = [(_packed(tokens[at:at + _BLOCK_ROWS], _TOKEN),) for at in range(0, len(tokens), _BLOCK_ROWS)]
            self.blocks.appendList(blocks)
        # What is held comes first and gives way only to a greater number.
        done = events["type"] == "done"
        answered = events[done & events["full_answer"].notna()].rename(columns={"seq": "done_seq", "full_answer": "answer"})
        answered = pd.concat([held[held["done_seq"].notna()], self._newest(answered, "done_seq", True)])
        cited = events[events["type"].isin(["citations", "done"]) & events["citations"].notna()].rename(columns={"seq": "cited_seq"})
        cited = pd.concat([held[held["cited_seq"].notna()], self._newest(cited, "cited_seq", False)])
        times = events[["request_id", "ts_ms"]].rename(columns={"ts_ms": "last_ms"}).assign(due_ms=events["ts_ms"].where(done))
        times = pd.concat([held[["request_id", "last_ms", "due_ms"]], times])
        said = times.groupby("request_id", dropna=False, sort=False)[["last_ms", "due_ms"]].max().reset_index()
        said = said.merge(self._newest(answered, "done_seq", True)[["request_id", "done_seq", "answer"]], "left", "request_id")
        said = said.merge(self._newest(cited, "cited_seq", True)[["request_id", "cited_seq", "citations"]], "left", "request_id")
        self.said.update((_packed(said, _SAID),))
        self.handle.registerTimer(max(int(self._ends(said).min()) + 1, passed))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        if not len(held):
            return
        passed = timerValues.getCurrentWatermarkInMs()
        ready = (self._ends(held) < passed).to_numpy(bool)
        out, rest = held[ready], held[~ready]
        if len(rest):
            self.handle.registerTimer(max(int(self._ends(rest).min()) + 1, passed + 1))
        if not len(out):
            return
        tokens = _unpacked([block[0] for block in self.blocks.get()], _TOKEN)
        leaving = tokens["request_id"].isin(out["request_id"])
        kept, tokens = tokens[~leaving], tokens[leaving].sort_values(["seq", "content"])
        if len(kept):
            self.blocks.put([(_packed(kept[at:at + _BLOCK_ROWS], _TOKEN),) for at in range(0, len(kept), _BLOCK_ROWS)])
        else:
            self.blocks.clear()
        if len(rest):
            self.said.update((_packed(rest, _SAID),))
        else:
            self.said.clear()
        joined = tokens.groupby("request_id", dropna=False, sort=False)["content"].agg(["size", "".join]).reset_index()
        out = out.merge(joined, "left", "request_id")
        text = out["answer"].fillna(out["join"]).fillna("")
        yield self._rows(
            out["request_id"], text, out["size"].fillna(0).to_numpy("int64"), out["citations"], out["due_ms"].notna().to_numpy(), 0
        )

    @staticmethod
    def _rows(requests, answer, count, citations, finished, late) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "request_id": requests.array,
                "answer": pd.array([None] * len(requests) if answer is None else answer, dtype="string"),
                "token_count": count,
                "citations": pd.array([None] * len(requests) if citations is None else citations, dtype="string"),
                "finished": finished,
                "late_events": late,
            }
        )

    def close(self) -> None:
        pass


def fold_events_stream(
    events: DataFrame, lateness: str = "10 minutes", idle_seconds: int = 3600, buckets: int = BUCKETS
) -> DataFrame:
    """Streaming twin of the batch fold; citations leave as JSON text.

    ``events``: request_id, seq, ts, type, content, full_answer, citations. A request
    comes out once: finished, when the watermark has passed its ``done``, or not,
    ``idle_seconds`` after its last event. Events that come after that are counted in
    rows of their own, with null answers and ``late_events``. State is held per bucket,
    of which a stream with very many open requests needs more.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    slim = timed.select(
        F.pmod(F.xxhash64("request_id"), F.lit(buckets)).cast("int").alias("bucket"),
        "request_id", F.col("seq").cast("bigint").alias("seq"), F.unix_millis("ts").alias("ts_ms"), "type", "content",
        "full_answer", F.to_json("citations").alias("citations"),
    )
    return slim.groupBy("bucket").transformWithStateInPandas(
        AnswerFold(idle_seconds * 1000), ANSWER_SCHEMA, outputMode="Append", timeMode="EventTime"
    )
