"""Sessions of participants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _valid(session: str):
    return F.when(F.col(session).rlike("^[0-9]{8}$") & F.try_to_date(F.col(session), "yyyyMMdd").isNotNull(), F.col(session))


def earliest_session(df: DataFrame, by: str, session: str, mode: str = "earliest") -> DataFrame:
    """Rows of each participant's earliest ``yyyyMMdd`` session; all rows where no session is a date.

    The earliest session is an aggregate joined back, so a participant with
    very many rows is not sorted in one task.
    """
    if mode == "all":
        return df
    first = df.groupBy(by).agg(F.min(_valid(session)).alias("__first"))
    return df.join(first, by).where(F.col("__first").isNull() | (F.col(session) == F.col("__first"))).drop("__first")


def session_audit(df: DataFrame, by: str, session: str, duration: str) -> DataFrame:
    """Per participant: the chosen session, its files and seconds, later sessions, and why."""
    first = df.groupBy(by).agg(F.min(_valid(session)).alias("selected_session"))
    joined = df.join(first, by)
    chosen = F.col("selected_session").isNull() | (F.col(session) == F.col("selected_session"))
    later = F.array_join(F.array_sort(F.collect_set(F.when(~chosen, F.col(session)))), "; ")
    audit = joined.groupBy(by, "selected_session").agg(F.count_if(chosen).alias("n_files"), F.sum(F.when(chosen, F.col(duration))).alias("total_sec"), later.alias("ignored_sessions"))
    return audit.withColumn("total_hours", F.col("total_sec") / 3600).withColumn("reason", F.when(F.col("selected_session").isNull(), "no valid session date: all files").otherwise("earliest session"))


def manifest_counts(df: DataFrame, participant: str, session: str) -> DataFrame:
    """(recordings, participants, sessions): sessions are distinct pairs, nulls included."""
    return df.agg(F.count("*").alias("recordings"), F.count_distinct(participant).alias("participants"), F.count_distinct(F.struct(participant, session)).alias("sessions"))


def limit_participants(df: DataFrame, by: str, n: int) -> DataFrame:
    return df.join(F.broadcast(df.select(by).distinct().orderBy(by).limit(n)), by, "left_semi")


def pick_one_file(files: DataFrame, by: str, path: str = "path", size: str | None = "size", exact: str | None = None) -> DataFrame:
    """One file for each key: the exact path if it is there, else the largest (by size, then path) or the first."""
    best = F.max_by(path, F.struct(size, path)) if size else F.min(path)
    own = F.max(F.when(F.col(path) == F.col(exact), F.col(path))) if exact else F.lit(None).cast("string")
    picked = files.groupBy(by).agg(F.coalesce(own, best).alias(path), F.count("*").alias("n_candidates"))
    return picked.withColumn("warning", F.when(F.col("n_candidates") > 1, F.format_string("%d files, one chosen", "n_candidates")))
