"""Cohort tables: z-scores, class summaries, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zscore(df: DataFrame, column: str, valid: Column | None = None, ddof: int = 0, name: str | None = None) -> DataFrame:
    """Add ``<name>`` and ``<name>2``: the value's distance from the valid rows' mean in their deviations.

    Valid rows are not null and not negative unless said otherwise; others are
    scaled too. Without any deviation valid rows get 0 and others null. The two
    moments are one row, broadcast.
    """
    name = name or f"{column}_z"
    valid = (F.col(column).isNotNull() & (F.col(column) >= 0)) if valid is None else valid
    held = F.when(valid, F.col(column))
    moments = df.agg(F.avg(held).alias("__mean"), (F.stddev_pop(held) if ddof == 0 else F.stddev_samp(held)).alias("__sd"))
    scaled = F.when(F.col("__sd") == 0, F.when(valid, 0.0)).otherwise((F.col(column) - F.col("__mean")) / F.col("__sd"))
    return df.crossJoin(F.broadcast(moments)).withColumn(name, scaled).withColumn(f"{name}2", F.col(name) * F.col(name)).drop("__mean", "__sd")


def unscale(z: Column, mean: float, deviation: float) -> Column:
    return z * deviation + mean


def class_summary(df: DataFrame, by: list[str], label: str, duration: str) -> DataFrame:
    """(by..., label, count, duration_sec): all rows counted, null durations skipped."""
    return df.groupBy(*by, label).agg(F.count("*").alias("count"), F.coalesce(F.sum(duration), F.lit(0.0)).alias("duration_sec"))


def class_durations(df: DataFrame, by: list[str], label: str, duration: str, classes: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.coalesce(F.sum(F.when(F.col(label) == c, F.col(duration))), F.lit(0.0)).alias(f"{c}_sec") for c in classes])


def recording_summary(stages: dict[str, DataFrame], by: str, duration: str) -> DataFrame:
    """Per recording the rows and seconds of each stage, 0 where it has none."""
    found = None
    for name, df in stages.items():
        counts = df.groupBy(by).agg(F.count("*").alias(f"n_{name}"), F.coalesce(F.sum(duration), F.lit(0.0)).alias(f"{name}_sec"))
        found = counts if found is None else found.join(counts, by, "full")
    return found.na.fill(0)


def dominant_speaker(df: DataFrame, by: list[str], speaker: str, duration: str, start: str = "start_sec") -> DataFrame:
    """The speaker with most seconds in a stream, of equal ones the earlier."""
    sums = df.groupBy(*by, speaker).agg(F.sum(duration).alias("total_sec"), F.min(start).alias("__first"))
    best = F.max_by(F.struct(speaker, "total_sec"), F.struct("total_sec", -F.col("__first"), speaker))
    return sums.groupBy(*by).agg(best.alias("b")).select(*by, F.col(f"b.{speaker}").alias("dominant"), F.col("b.total_sec").alias("total_sec"))


def build_report(df: DataFrame, issues: DataFrame, present: dict[str, str], outputs: dict[str, DataFrame] | None = None) -> DataFrame:
    """(metric, value): participants, matches and gaps of each source, issues by kind, rows of the outputs."""
    one = df.agg(F.count("*").alias("participants"), *[F.count(c).alias(f"matched_{n}") for n, c in present.items()], *[F.count_if(F.col(c).isNull()).alias(f"missing_{n}") for n, c in present.items()])
    counts = one.unpivot([], one.columns, "metric", "value")
    counts = counts.union(issues.groupBy(F.concat(F.lit("issue_"), "issue_type").alias("metric")).agg(F.count("*").alias("value")))
    for name, out in (outputs or {}).items():
        counts = counts.union(out.agg(F.count("*")).select(F.lit(f"rows_{name}"), "count(1)"))
    return counts


#: Public columns of a participant.
SUMMARY_COLUMNS = ("participant_id", "age_days", "age_months", "child_sex", "mother_education", "father_education", "Location", "audio_hours")


def participant_summary(master: DataFrame, columns: tuple[str, ...] = SUMMARY_COLUMNS) -> DataFrame:
    """The public columns that the master table has."""
    from segflow.operators.reshape import select_available

    return select_available(master, list(columns))
