"""Cache replay as a stream: rows are put in order of time before they are labelled.

Whether a row is a hit depends on all earlier rows of its key, and rows do not arrive
in order. Each key keeps the rows that the watermark has not passed yet; a timer
releases them, sorted, once it has, when nothing earlier is to come. Rows that arrive
behind the watermark cannot be put in order any more: they come out unlabelled, marked
``late``, and change no other row's label. None is dropped.

An ingest starts a new generation of every key, so there may be nearly as many pairs of
key and generation as rows. State and timers are therefore held for a key and a slice
of its generations, and a call works on all of their rows at once: what a micro-batch
costs beyond its rows goes by keys and slices, not by generations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from citemill.functions import fixed_values as fixed

REPLAY_SCHEMA = "cache_key string, generation bigint, event_id bigint, ts_us bigint, hit boolean, late boolean"
GENERATION_SLICES = 16
NO_GENERATION = -1
_ROW = np.dtype([("generation", "<i8"), ("ts_us", "<i8"), ("event_id", "<i8"), ("cacheable", "?")])
_ENTRY = np.dtype([("generation", "<i8"), ("written_us", "<i8")])
_BLOCK_ROWS = 1 << 15


def label_rows(times: np.ndarray, cacheable: np.ndarray, written: int | None, ttl_us: int) -> tuple[np.ndarray, int | None]:
    """Hits of rows in order of time, and the time of the entry that is left.

    One step per entry, not per row: from an entry on, all rows within its life are hits.
    """
    hits = np.zeros(len(times), bool)
    at = 0
    while at < len(times):
        if written is not None:
            end = int(np.searchsorted(times, written + ttl_us))
            hits[at:end] = True
            at = max(at, end)
            written = written if at == len(times) else None
            continue
        later = np.flatnonzero(cacheable[at:])
        if not len(later):
            break
        at += int(later[0])
        written = int(times[at])
        at += 1
    return hits, written


def label_generations(rows: np.ndarray, entries: np.ndarray, ttl_us: int) -> tuple[np.ndarray, np.ndarray]:
    """Hits of rows in order of generation and time, and the entries that are left.

    A generation without an entry whose rows span less than one TTL is served by its
    first cacheable row; only the others are read entry by entry.
    """
    begins = np.flatnonzero(np.diff(rows["generation"], prepend=rows["generation"][:1] - 1))
    ends = np.append(begins[1:], len(rows))
    generations, times = rows["generation"][begins], rows["ts_us"]
    known = dict(zip(entries["generation"].tolist(), entries["written_us"].tolist()))
    place = np.arange(len(rows))
    first = np.minimum.reduceat(np.where(rows["cacheable"], place, len(rows)), begins)
    hits = place > np.repeat(np.where(first < ends, first, len(rows)), ends - begins)
    written = {g: int(times[at]) for g, at, end in zip(generations.tolist(), first.tolist(), ends.tolist()) if at < end}
    walked = (times[ends - 1] - times[begins] >= ttl_us) | np.isin(generations, entries["generation"])
    for run in np.flatnonzero(walked):
        part, generation = slice(begins[run], ends[run]), int(generations[run])
        hits[part], now = label_rows(times[part], rows["cacheable"][part], known.pop(generation, None), ttl_us)
        written.pop(generation, None)
        if now is not None:
            written[generation] = now
    return hits, np.array(list((known | written).items()), dtype=np.int64).reshape(-1, 2).copy().view(_ENTRY).ravel()


class CacheReplay(StatefulProcessor):
    """Per key and slice of generations: the rows still ahead of the watermark, and the live entries.

    Rows are appended in packed blocks as they arrive, so a micro-batch writes only what
    it brought. What is held is bounded by the allowed lateness, and an entry goes one
    TTL after it was written.
    """

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "rows binary")
        self.entries = handle.getValueState("entries", "written binary")

    @staticmethod
    def _rows(key, generation, event_id, ts_us, hits, late: bool) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "cache_key": key[0],
                "generation": pd.array([None] * len(event_id) if key[1] == NO_GENERATION else generation, dtype="Int64"),
                "event_id": event_id,
                "ts_us": ts_us,
                "hit": pd.array(hits, dtype="boolean"),
                "late": late,
            }
        )

    @staticmethod
    def _blocks(rows: np.ndarray) -> list[tuple[bytes]]:
        return [(rows[at:at + _BLOCK_ROWS].tobytes(),) for at in range(0, len(rows), _BLOCK_ROWS)]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed_us = timerValues.getCurrentWatermarkInMs() * 1000
        kept = []
        for batch in rows:
            # A row without a time cannot be put in order either.
            ahead = batch["ts_us"] >= passed_us
            if not ahead.all():
                late = batch[~ahead]
                columns = (late[name].to_numpy() for name in ("generation", "event_id", "ts_us"))
                yield self._rows(key, *columns, [None] * len(late), True)
            part = batch[ahead]
            packed = np.empty(len(part), _ROW)
            for name in _ROW.names:
                packed[name] = part[name].to_numpy()
            kept.append(packed)
        kept = np.concatenate(kept)
        if len(kept):
            self.pending.appendList(self._blocks(kept))
            self.handle.registerTimer(int(kept["ts_us"].min()) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed_us = timerValues.getCurrentWatermarkInMs() * 1000
        blocks = [np.frombuffer(block[0], _ROW) for block in self.pending.get()]
        held = np.concatenate([np.empty(0, _ROW), *blocks])
        before = np.frombuffer(self.entries.get()[0], _ENTRY) if self.entries.exists() else np.empty(0, _ENTRY)
        entries = before
        ready = held["ts_us"] < passed_us
        if ready.any():
            rest = held[~ready]
            if len(rest):
                self.pending.put(self._blocks(rest))
                self.handle.registerTimer(int(rest["ts_us"].min()) // 1000 + 1)
            else:
                self.pending.clear()
            due = held[ready]
            due = due[np.lexsort((due["event_id"], due["ts_us"], due["generation"]))]
            hits, entries = label_generations(due, before, self.ttl_us)
            yield self._rows(key, due["generation"], due["event_id"], due["ts_us"], hits, False)
        live = entries[entries["written_us"] + self.ttl_us > passed_us]
        if len(live):
            if ready.any() or len(live) < len(before):
                self.entries.update((live.tobytes(),))
            self.handle.registerTimer(int(live["written_us"].max() + self.ttl_us) // 1000 + 1)
        elif len(before):
            self.entries.clear()

    def close(self) -> None:
        pass


def replay_cache_stream(
    log: DataFrame,
    ttl_seconds: int = fixed.CACHE_TTL_SECONDS,
    lateness: str = "1 hour",
    slices: int = GENERATION_SLICES,
) -> DataFrame:
    """Streaming twin of the batch replay; rows come out once the watermark has passed them.

    ``log``: cache_key, generation, event_id, ts, cacheable. Rows up to ``lateness``
    behind the newest are put in order; later ones come out with ``late`` true and
    ``hit`` null. The generations of a key are spread over ``slices``.
    """
    timed = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    # Without the time column itself Spark drops no late row before it gets to the processor.
    slim = timed.select(
        "cache_key",
        F.coalesce(F.pmod("generation", F.lit(slices)).cast("int"), F.lit(NO_GENERATION)).alias("slice"),
        F.coalesce("generation", F.lit(NO_GENERATION)).cast("bigint").alias("generation"),
        "event_id",
        F.unix_micros("ts").alias("ts_us"),
        F.coalesce("cacheable", F.lit(False)).alias("cacheable"),
    )
    return slim.groupBy("cache_key", "slice").transformWithStateInPandas(
        CacheReplay(ttl_seconds * 1_000_000), REPLAY_SCHEMA, outputMode="Append", timeMode="EventTime"
    )
