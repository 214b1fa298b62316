"""The cohort data set: recordings and segments of participants as one table, then long."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segflow.operators.cohort import class_summary, zscore
from segflow.operators.reshape import pivot_wide, rate_columns


def class_rates(segments: DataFrame, hours: DataFrame, key: str, label: str, duration: str, classes: list[str], hours_col: str = "hours") -> DataFrame:
    """Per participant and class: counts, seconds and both by recorded hour.

    ``hours`` has a row for each participant; those without segments keep null
    classes, others 0 for a class that is absent.
    """
    summary = class_summary(segments, [key], label, duration)
    matched = summary.select(key).distinct().withColumn("matched", F.lit(True))
    keys = hours.join(matched, key, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))
    wide = pivot_wide(summary, keys, key, label, classes, {"count": "count", "duration_sec": "duration_sec"}, "matched")
    return rate_columns(wide, classes, hours_col, {"count": "count_hour", "duration_sec": "duration_hour"})


def master_table(metadata: DataFrame, hours: DataFrame, segments: DataFrame, key: str, label: str, duration: str, classes: list[str], age: str) -> DataFrame:
    """Metadata beside rates, with the age's z-score; every participant of the metadata has a row."""
    rates = class_rates(segments, hours, key, label, duration, classes)
    return zscore(metadata.join(rates, key, "left"), age)
