"""Dispatch counts of a scan and the message that sums them up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citemill.functions import fixed_values as fixed


def dispatch_summary(dispatched: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Successful and all dispatches, per scan when ``by`` is given."""
    return dispatched.groupBy(*(by or [])).agg(
        F.count_if("ok").alias("synchronized"), F.count("*").alias("dispatched")
    )


def scan_status(manual: Column, healthy: Column, synchronized: Column, dispatched: Column) -> Column:
    """Status line of a scheduled or manual scan."""
    manual_line = F.when(~healthy, fixed.STATUS_MANUAL_ABORTED).otherwise(
        F.format_string(fixed.STATUS_MANUAL_DONE, synchronized, dispatched)
    )
    scheduled_line = (
        F.when(~healthy, fixed.STATUS_DEFERRED)
        .when(dispatched == 0, fixed.STATUS_UP_TO_DATE)
        .otherwise(F.format_string(fixed.STATUS_DONE, synchronized, dispatched))
    )
    return F.when(manual, manual_line).otherwise(scheduled_line)
