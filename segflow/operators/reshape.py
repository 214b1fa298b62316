"""Columns in and out, wide and long, unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select_available(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select([c for c in columns if c in df.columns])


def rename_roles(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def min_duration(df: DataFrame, least: float, duration: str = "duration_sec") -> DataFrame:
    return df.where(F.col(duration) >= least)


def confidence_filter(df: DataFrame, least: float, column: str = "predicted_confidence") -> DataFrame:
    return df.where(F.col(column) >= least) if column in df.columns else df


def select_form(df: DataFrame, form: str, column: str = "submitted_form") -> DataFrame:
    """The rows of one form."""
    return df.where(F.col(column) == form)


def blank_label_filter(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.trim(column) != "")


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=columns)


def to_long_items(df: DataFrame, ids: list[str], items: list[str]) -> DataFrame:
    """One row for each submission and item column, with the raw answer."""
    return df.unpivot(ids, items, "raw_column", "raw_response")


def to_long_speakers(df: DataFrame, speakers: list[str], shared: list[str], measures: tuple[str, ...] = ("count_hour", "duration_hour"), prefix: str = "input_") -> DataFrame:
    """One row for each row and speaker; ``<speaker>_<measure>`` becomes ``<prefix><measure>``."""
    each = F.array(*[F.struct(F.lit(s).alias("speaker"), *[F.col(f"{s}_{m}").alias(f"{prefix}{m}") for m in measures]) for s in speakers])
    return df.select(*shared, F.inline(each))


def to_long_input_output(df: DataFrame, speakers: list[str], output: str, shared: list[str], measures: tuple[str, ...] = ("count_hour", "duration_hour")) -> DataFrame:
    """As ``to_long_speakers``, with the output speaker's measures on every row."""
    return to_long_speakers(df, speakers, [*shared, *[f"{output}_{m}" for m in measures]], measures)


def pivot_wide(summary: DataFrame, keys: DataFrame, key: str, label: str, classes: list[str], measures: dict[str, str], matched: str) -> DataFrame:
    """``<class>_<measure>`` columns for fixed classes beside every key; 0 for an absent class of a matched key, else null.

    ``measures`` maps a suffix to the summary's column; ``matched`` is a
    boolean column of ``keys``.
    """
    wide = summary.groupBy(key).agg(*[F.sum(F.when(F.col(label) == c, F.col(m))).cast("double").alias(f"{c}_{suffix}") for c in classes for suffix, m in measures.items()])
    names = [f"{c}_{s}" for c in classes for s in measures]
    joined = keys.join(wide, key, "left")
    return joined.withColumns({n: F.when(F.col(matched), F.coalesce(F.col(n), F.lit(0.0))) for n in names})


def rate(value: Column, hours: Column) -> Column:
    """Value by hour, null unless there are hours."""
    return F.when(value.isNotNull() & (hours > 0), value / hours)


def rate_columns(df: DataFrame, speakers: list[str], hours: str, measures: dict[str, str]) -> DataFrame:
    """Add ``<speaker>_<rate>`` for each measure that ``measures`` maps to a rate's name."""
    return df.withColumns({f"{s}_{r}": rate(F.col(f"{s}_{m}"), F.col(hours)) for s in speakers for m, r in measures.items()})


def seconds_to_hours(seconds: Column) -> Column:
    return seconds / 3600


def minutes_per_hour(seconds_per_hour: Column) -> Column:
    return seconds_per_hour / 60


def final_projection(df: DataFrame, columns: list[str], dates: tuple[str, ...] = ()) -> DataFrame:
    return df.withColumns({d: F.date_format(d, "yyyy-MM-dd") for d in dates}).select(columns)


def distinct_options(df: DataFrame, item: str, word: str, english: str) -> DataFrame:
    """Items with a label ``english / word``, by English word."""
    return df.select(item, word, english).distinct().withColumn("label", F.concat_ws(" / ", english, word)).orderBy(english, item)


def union_by_name(*frames: DataFrame) -> DataFrame:
    found = frames[0]
    for other in frames[1:]:
        found = found.unionByName(other, allowMissingColumns=True)
    return found


def union_tiers(tiers: dict[str, DataFrame], label: str = "label") -> DataFrame:
    """Interval tables as one, each with its class."""
    return union_by_name(*[df.withColumn(label, F.lit(name)) for name, df in tiers.items()])
