"""Law checks over a stream (an extension): events counted in windows, late ones bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def violations_by_window(events: DataFrame, broken, delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """start, event_type, n, n_broken; ``broken`` is a column over the events. Works on a stream and on a table."""
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(broken).alias("n_broken")).select(F.col("w.start").alias("start"), "event_type", "n", "n_broken")
