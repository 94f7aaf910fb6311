"""Usage log as a stream: an extension, with the same result as the batch query on finite input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicated(events: DataFrame, *, at: str = "ts", keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first event of each key within the watermark; later copies are dropped, state is bounded."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def usage_windows(events: DataFrame, *, at: str = "ts", key: str, late: str = "10 minutes", width: str = "1 day") -> DataFrame:
    """Uses of each key in tumbling windows of event time."""
    w = events.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count("*").alias("n"), F.max(at).alias("last_used_at"))
    return w.select(F.col("window.start").alias("start"), key, "n", "last_used_at")
