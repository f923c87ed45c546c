"""Which questions of a log an answer cache would have served.

The rule: an entry is written by a miss that may be cached and serves the same
key for one TTL. A hit does not lengthen its life, and an ingest empties the
cache. So entries form a chain per key: the first cacheable row, then the first
cacheable row at least one TTL after it, and so on.

The chain is sequential, but no key is walked in one task unless it is small:

* Keys with up to ``walk_rows`` distinct times are read in order by one task each,
  which keeps just the last entry in memory.
* Larger keys are cut into slots as long as the TTL. A slot holds at most one
  entry, and an entry decides, from its offset alone, the entry of the next slot.
  These steps are put together pairwise (1, 2, 4, ... slots ahead), and the chain
  is read off in as many rounds, each an equi-join on (key, slot, offset).

Rows are then labelled by an equi-join on (key, slot), where at most two entries
matter, so a busy key is spread over its slots.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citemill.functions import fixed_values as fixed
from citemill.session import shared_folder

WALK_ROWS = 1_000_000
GENERATION_SALTS = 16
_NO_ENTRY = -1


def cache_generations(
    log: DataFrame, ingests: DataFrame, salts: int = GENERATION_SALTS
) -> DataFrame:
    """Add ``generation``: the number of ingests up to and including the row's time.

    ``log`` and ``ingests`` have ``ts`` (timestamp). Counting goes by hour: whole
    earlier hours come from an hourly table (its length is the log's time span),
    and inside an hour the rows are spread over ``salts`` windows, each of which
    gets the hour's ingest counts.
    """
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600)
    counts = ingests.groupBy("ts").agg(F.count("*").alias("__n")).withColumn("__hour", hour)

    earlier = Window.orderBy("__hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = (
        log.select(hour.alias("__hour"), F.lit(0).cast("bigint").alias("__n"))
        .unionByName(counts.select("__hour", "__n"))
        .groupBy("__hour")
        .agg(F.sum("__n").alias("__n"))
        .select("__hour", F.sum("__n").over(earlier).alias("__before"))
    )

    rows = log.withColumns(
        {"__hour": hour, "__salt": F.pmod(F.xxhash64(*log.columns), F.lit(salts)).cast("int")}
    )
    marks = counts.select(
        "ts", "__hour", "__n", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt")
    )
    together = rows.withColumn("__n", F.lit(None).cast("bigint")).unionByName(marks, allowMissingColumns=True)
    # Equal times count as earlier, so the frame takes in peers of the row.
    inside = Window.partitionBy("__hour", "__salt").orderBy("ts").rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    counted = together.withColumn("__inside", F.sum("__n").over(inside)).filter("__n is null")
    zero = F.lit(0).cast("bigint")
    return counted.join(hours, "__hour", "left").select(
        *log.columns,
        (F.coalesce("__inside", zero) + F.coalesce("__before", zero)).alias("generation"),
    )


def _slot(micros: str, ttl: int) -> Column:
    return F.expr(f"{micros} div {ttl}L")


def _entries(times: DataFrame, keys: list[str], ttl: int, walk_rows: int) -> DataFrame:
    """The entries of every key: keys, __us (when it was written), __writer.

    ``times`` holds each key's distinct cacheable times with their first row.
    """
    sizes = times.groupBy(*keys).agg(F.count("*").alias("__rows"))
    busy = sizes.filter(F.col("__rows") > walk_rows).select(*keys)
    if busy.isEmpty():
        return _walk_small_keys(times, keys, ttl)
    small = times.join(busy, keys, "left_anti")
    large = times.join(busy, keys, "left_semi")
    chained = large.join(_chain_large_keys(large, keys, ttl), [*keys, "__us"], "left_semi")
    return _walk_small_keys(small, keys, ttl).unionByName(chained)


def _walk_small_keys(times: DataFrame, keys: list[str], ttl: int) -> DataFrame:
    """Entries of keys of at most ``walk_rows`` times, read in order.

    Only the last entry is remembered from one Arrow batch to the next.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, written = None, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            micros = batch.column("__us").to_numpy()
            starts_key = _differs_from_previous(batch, keys)
            starts_key[0] = tuple(batch.column(key)[0].as_py() for key in keys) != last_key
            # A row a full TTL after the one before it is an entry in any case.
            head = starts_key | (np.diff(micros, prepend=micros[0]) >= ttl)
            begins = np.flatnonzero(head)
            ends = np.append(begins[1:], len(micros))
            taken = [begins]
            if not head[0]:
                stop = begins[0] if len(begins) else len(micros)
                taken.append(_later_entries(micros, 0, stop, written, ttl))
            for run in np.flatnonzero(micros[ends - 1] - micros[begins] >= ttl):
                taken.append(_later_entries(micros, begins[run], ends[run], micros[begins[run]], ttl))
            rows = np.sort(np.concatenate(taken)).astype(np.int64)
            if len(rows):
                written = int(micros[rows[-1]])
                yield batch.take(pa.array(rows))
            last_key = tuple(batch.column(key)[-1].as_py() for key in keys)

    rows = times.select(*keys, "__us", "__writer")
    schema = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in rows.schema)
    return rows.repartition(*keys).sortWithinPartitions(*keys, "__us").mapInArrow(walk, schema)


def _differs_from_previous(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Where any key column changes; the first row counts as a change."""
    changed = np.zeros(batch.num_rows, dtype=bool)
    changed[0] = True
    for key in keys:
        column = batch.column(key)
        same = pc.equal(column.slice(1), column.slice(0, batch.num_rows - 1)).fill_null(False)
        changed[1:] |= ~same.to_numpy(zero_copy_only=False)
    return changed


def _later_entries(micros: np.ndarray, begin: int, end: int, written: int, ttl: int) -> np.ndarray:
    """Positions of the entries after the one written at ``written``."""
    found = []
    while True:
        begin += int(np.searchsorted(micros[begin:end], written + ttl))
        if begin >= end:
            return np.array(found, dtype=np.int64)
        found.append(begin)
        written = int(micros[begin])


def _chain_large_keys(times: DataFrame, keys: list[str], ttl: int) -> DataFrame:
    """Entry times of keys too large to fold, by doubling steps over slots."""
    shared_folder(times.sparkSession)
    slotted = times.withColumn("__slot", _slot("__us", ttl))
    starts = slotted.groupBy(*keys).agg(
        F.min("__slot").alias("__origin"), F.max("__slot").alias("__last"), F.min("__us").alias("__first")
    ).checkpoint()
    events = slotted.join(starts, keys).select(
        *keys,
        (F.col("__slot") - F.col("__origin")).alias("slot"),
        (F.col("__us") - F.col("__slot") * ttl).alias("off"),
    )
    empty = starts.select(
        *keys,
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__last") - F.col("__origin"))).alias("slot"),
        F.lit(_NO_ENTRY).cast("bigint").alias("off"),
    )
    states = events.unionByName(empty)

    # One slot ahead: the first event there whose offset is not below the state's.
    asked = states.select(*keys, (F.col("slot") + 1).alias("slot"), "off", F.lit(1).alias("is_state"))
    marks = events.select(*keys, "slot", "off", F.lit(0).alias("is_state"))
    downward = (
        Window.partitionBy(*keys, "slot")
        .orderBy(F.desc("off"), "is_state")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    step = (
        marks.unionByName(asked)
        .withColumn("to_off", F.last(F.when(F.col("is_state") == 0, F.col("off")), ignorenulls=True).over(downward))
        .filter("is_state = 1")
        .select(
            *keys,
            (F.col("slot") - 1).alias("slot"),
            "off",
            F.coalesce("to_off", F.lit(_NO_ENTRY)).alias("to_off"),
        )
        .checkpoint()
    )

    span = starts.agg(F.max(F.col("__last") - F.col("__origin"))).first()[0]
    steps, reach = [step], 1
    while reach * 2 <= span:
        ahead = steps[-1]
        onward = ahead.select(*keys, F.col("slot").alias("mid"), F.col("off").alias("to_off"), F.col("to_off").alias("far_off"))
        doubled = (
            ahead.filter(F.col("slot") % (2 * reach) == 0)
            .withColumn("mid", F.col("slot") + reach)
            .join(onward, [*keys, "mid", "to_off"])
            .select(*keys, "slot", "off", F.col("far_off").alias("to_off"))
        )
        steps.append(doubled.checkpoint())
        reach *= 2

    known = starts.select(
        *keys, F.lit(0).cast("bigint").alias("slot"), (F.col("__first") - F.col("__origin") * ttl).alias("off")
    )
    for ahead in reversed(steps):
        reached = known.join(ahead, [*keys, "slot", "off"]).select(
            *keys, (F.col("slot") + reach).alias("slot"), F.col("to_off").alias("off")
        )
        known = known.unionByName(reached).checkpoint()
        reach //= 2
    return (
        known.filter(F.col("off") != _NO_ENTRY)
        .join(starts, keys)
        .filter(F.col("slot") <= F.col("__last") - F.col("__origin"))
        .select(*keys, ((F.col("slot") + F.col("__origin")) * ttl + F.col("off")).alias("__us"))
    )


def replay_cache(
    log: DataFrame,
    keys: list[str] | None = None,
    ttl_seconds: int = fixed.CACHE_TTL_SECONDS,
    walk_rows: int = WALK_ROWS,
) -> DataFrame:
    """Add ``hit`` to every row of a question log.

    ``log``: event_id (unique, orders equal times), ts, cacheable and the key
    columns (``cache_key`` by default; with ``generation`` an ingest empties the
    cache).
    """
    keys = keys or ["cache_key"]
    ttl = ttl_seconds * 1_000_000
    timed = log.withColumn("__us", F.unix_micros(F.col("ts").cast("timestamp")))
    # An entry is written by the first cacheable row of its time.
    times = timed.filter("cacheable").groupBy(*keys, "__us").agg(F.min("event_id").alias("__writer"))
    # It serves from there to one TTL later, which touches two slots.
    serving = (
        _entries(times, keys, ttl, walk_rows)
        .select(
            *keys,
            F.struct("__us", "__writer").alias("__entry"),
            F.explode(F.array(_slot("__us", ttl), _slot("__us", ttl) + 1)).alias("__slot"),
        )
        .groupBy(*keys, "__slot")
        .agg(F.min("__entry").alias("__early"), F.max("__entry").alias("__late"))
    )

    def covers(entry: str) -> Column:
        begin = F.col(f"{entry}.__us")
        after = (F.col("__us") > begin) | ((F.col("__us") == begin) & (F.col("event_id") > F.col(f"{entry}.__writer")))
        return after & (F.col("__us") < begin + ttl)

    labelled = timed.withColumn("__slot", _slot("__us", ttl)).join(serving, [*keys, "__slot"], "left")
    hit = F.coalesce(covers("__early") | covers("__late"), F.lit(False))
    return labelled.select(*[labelled[name] for name in log.columns], hit.alias("hit"))
