"""The class summary over a stream of segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_class_summary(segments: DataFrame, time: str, by: list[str], label: str, duration: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and seconds by class in event-time windows; rows later than ``late`` behind the newest are left out of closed windows.

    Works on streams and tables alike.
    """
    source = segments.withWatermark(time, late) if segments.isStreaming else segments
    summed = source.groupBy(F.window(time, window), *by, label).agg(F.count("*").alias("count"), F.sum(duration).alias("duration_sec"))
    return summed.select(F.col("window.start").alias("window_start"), *by, label, "count", "duration_sec")
