"""Joins with contracts, reference chains and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segflow.operators.quality import ContractError


def duplicate_keys(df: DataFrame, on: list[str]) -> DataFrame:
    return df.na.drop(subset=on).groupBy(on).agg(F.count("*").alias("n")).where("n > 1")


def join_validated(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", validate: str = "m:1") -> DataFrame:
    """A join whose keys must be unique on the right (``m:1``) or on both sides (``1:1``); null keys never match."""
    for side, df in (("right", right), *((("left", left),) if validate == "1:1" else ())):
        if bad := duplicate_keys(df, on).take(1):
            raise ContractError(f"{validate}: {side} key {bad[0].asDict()} occurs more than once")
    return left.join(right, on, how)


def link_chain(base: DataFrame, links: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """Left joins one after the other; each link is (right, key so far, right's key, name) and adds ``has_<name>_link``.

    Right sides must have unique keys; reduce them first (``contact_rollup``).
    """
    for right, left_key, right_key, name in links:
        keyed = right.withColumn("__key", F.col(right_key))
        joined = base.join(keyed.withColumnRenamed(right_key, f"__{name}") if right_key in base.columns else keyed, F.col(left_key) == F.col("__key"), "left")
        base = joined.withColumn(f"has_{name}_link", F.col("__key").isNotNull()).drop("__key", f"__{name}")
    return base


def attach_lookup(df: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Left join on the trimmed key; no row is lost."""
    return df.withColumn(key, F.trim(F.col(key).cast("string"))).join(lookup, key, "left")


def restrict_to(df: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the chosen ones."""
    return df.join(chosen.select(key), key, "left_semi")


def unmapped(observed: DataFrame, mapped: DataFrame, column: str) -> DataFrame:
    """(side, value): observed and not mapped, mapped and not observed."""
    a, b = observed.select(column).distinct(), mapped.select(column).distinct()
    return a.join(b, column, "left_anti").select(F.lit("observed_not_mapped").alias("side"), F.col(column).alias("value")).union(b.join(a, column, "left_anti").select(F.lit("mapped_not_observed"), column))


def merge_existing_labels(sample: DataFrame, done: DataFrame, keys: list[str], label: str = "manual_label") -> DataFrame:
    return sample.drop(label).join(done.select(*keys, label), keys, "left").withColumn(label, F.coalesce(label, F.lit("")))


def augment_group_counts(df: DataFrame, rows: DataFrame, group: str) -> DataFrame:
    """Beside each row the number of rows of its group."""
    return df.join(rows.groupBy(group).agg(F.count("*").alias("n_group")), group, "left")


def link_questions(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """(question, responses, category): evidence categories that a question's response keys meet, or none."""
    each = questions.select("question", F.explode("response_keys").alias("response_key"))
    found = each.join(evidence.select("response_key", "category"), "response_key", "left")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "; ")
    return found.groupBy("question").agg(joined("response_key").alias("responses"), joined("category").alias("category")).withColumn("category", F.when(F.col("category") == "", "Inconclusive evidence").otherwise(F.col("category")))


def term_stats_join(effects: DataFrame, stats: DataFrame, key: str = "term") -> DataFrame:
    """Effects with degrees of freedom and p-values, their own ones first."""
    other = stats.select(key, F.col("df").alias("__df"), F.col("p_value").alias("__p"))
    return effects.join(other, key, "left").withColumn("df", F.coalesce("df", "__df")).withColumn("p_value", F.coalesce("p_value", "__p")).drop("__df", "__p")
