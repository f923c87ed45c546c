"""Running values over an ordered key, without one task per key.

A plain window puts every row of a key into one task, so a single huge document
would hold up the job. Here each key is cut into blocks of its order column. A
slim aggregate carries values from block to block, and the window runs inside
(key, block). The window and, after it, the join that brings the carried values
share one shuffle and one sort, so wide columns move once, as they would in the
plain form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 1024
_BLOCK = "__block"


def running_values(
    rows: DataFrame,
    keys: list[str],
    order: str,
    last: dict[str, str] | None = None,
    totals: dict[str, str] | None = None,
    block_rows: int = BLOCK_ROWS,
    tasks: int | None = None,
) -> DataFrame:
    """Add running columns to ``rows``.

    ``last`` maps an output name to a column: its last non-null value up to and
    including the row. ``totals`` maps an output name to a column: its sum over
    earlier rows (0 for the first). ``order`` is an integer, unique within a key.

    ``tasks`` is for callers with much work per row to come: Spark merges shuffled
    partitions by their bytes until there are about as many as cores, of which the last
    few keep all others waiting; so many it leaves alone.
    """
    last, totals = last or {}, totals or {}
    blocked = rows.withColumn(_BLOCK, F.floor(F.col(order) / block_rows))

    found = [
        F.max_by(column, F.when(F.col(column).isNotNull(), F.col(order))).alias(f"__last_{out}")
        for out, column in last.items()
    ]
    sums = [F.sum(column).alias(f"__sum_{out}") for out, column in totals.items()]
    before = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = blocked.groupBy(*keys, _BLOCK).agg(*found, *sums).select(
        *keys,
        _BLOCK,
        *[F.last(f"__last_{out}", ignorenulls=True).over(before).alias(f"__last_{out}") for out in last],
        *[F.sum(f"__sum_{out}").over(before).alias(f"__sum_{out}") for out in totals],
    )

    inside = Window.partitionBy(*keys, _BLOCK).orderBy(order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)

    # In this order the window's sort serves the join too.
    dealt = blocked.repartition(tasks, *keys, _BLOCK) if tasks else blocked
    within = dealt.select(
        *blocked.columns,
        *[F.last(column, ignorenulls=True).over(so_far).alias(f"__within_last_{out}") for out, column in last.items()],
        *[F.sum(column).over(earlier).alias(f"__within_sum_{out}") for out, column in totals.items()],
    )

    def running_last(out: str) -> Column:
        return F.coalesce(f"__within_last_{out}", f"__last_{out}")

    def running_total(out: str) -> Column:
        zero = F.lit(0).cast("bigint")
        return F.coalesce(f"__within_sum_{out}", zero) + F.coalesce(f"__sum_{out}", zero)

    joined = within.join(carried, [*keys, _BLOCK], "left")
    return joined.select(
        *[joined[name] for name in rows.columns],
        *[running_last(out).alias(out) for out in last],
        *[running_total(out).alias(out) for out in totals],
    )
