"""Carriage counts per time bucket over a stream; an extension, the batch form is a grouped count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def carriage(events: DataFrame, time: str, kind: str, width: str = "30 days", late: str = "7 days") -> DataFrame:
    """(start, kind, n): counts per tumbling window; rows later than ``late`` after the newest are dropped."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width).alias("w"), F.col(kind)).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("start"), kind, "n")
