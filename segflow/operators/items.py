"""Questionnaire items: dictionary, completeness, scores, proportions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segflow.functions.text import membership_flags, normalize_text, parse_item_id


def build_dictionary(items: DataFrame, forms: dict[str, DataFrame], id_text: str, label: str, forms_text: str, order: str) -> DataFrame:
    """Items with parsed ids, form flags, and the place of their label among each form's columns."""
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(order))  # a dictionary has hundreds of rows
    made = items.withColumn("__place", place).withColumn("item_id", parse_item_id(F.col(id_text), F.col("__place"))).withColumn("label_norm", normalize_text(F.col(label)))
    made = made.select("*", *membership_flags(F.col(forms_text)), F.lit(1).alias("active")).drop("__place")
    for name, columns in forms.items():
        made = made.join(columns.select(normalize_text(F.col("column")).alias("label_norm"), F.col("position").alias(f"position_{name}")), "label_norm", "left")
    return made


def dictionary_validation(dictionary: DataFrame, observed: DataFrame) -> DataFrame:
    """(issue, value): repeated ids and labels, labels on one side alone, and those that agree only after cleaning."""
    ids = dictionary.groupBy("item_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_item_id").alias("issue"), F.col("item_id").cast("string").alias("value"))
    norm, seen = dictionary.select("item_id", "raw_column", normalize_text(F.col("raw_column")).alias("norm")), observed.select(F.col("column"), normalize_text(F.col("column")).alias("norm"))
    labels = norm.groupBy("norm").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.col("item_id").cast("string"))), " | ").alias("value")).where("n > 1").select(F.lit("duplicate_label"), "value")
    unmapped = seen.join(norm, "norm", "left_anti").select(F.lit("observed_not_mapped"), "column")
    unseen = norm.join(seen, "norm", "left_anti").groupBy("norm").agg(F.array_join(F.array_sort(F.collect_set(F.col("item_id").cast("string"))), " | ").alias("value")).select(F.lit("mapped_not_observed"), "value")
    loose = norm.join(seen, "norm").where("raw_column <> column").select(F.lit("normalization_only_match"), "column")
    return ids.union(labels).union(unmapped).union(unseen).union(loose)


def item_dimension_join(long: DataFrame, items: DataFrame, column: str = "raw_column") -> DataFrame:
    return long.withColumn("__norm", normalize_text(F.col(column))).join(items.withColumn("__norm", normalize_text(F.col(column))).drop(column), "__norm", "left").drop("__norm")


def dedup_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.groupBy(key).agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), F.struct(*order)).alias("__row")).select(key, "__row.*")


def completeness(long: DataFrame, by: list[str], position: str, response: str, expected: int, longest_blank: int = 25) -> DataFrame:
    """Answered items, the blank run at the end, and what that says of a form."""
    filled = F.coalesce(F.trim(response), F.lit("")) != ""
    counts = long.groupBy(*by).agg(F.count("*").alias("n_present"), F.count_if(filled).alias("n_non_blank"), F.coalesce(F.max(F.when(filled, F.col(position))), F.lit(0)).alias("__last"))
    present = F.col("n_present") >= expected
    run = F.when(present, F.lit(expected) - F.col("__last")).cast("long")
    status = F.when(~present, "missing_item_columns").when(F.col("trailing_blank_run") == expected, "all_blank").when(F.col("trailing_blank_run") <= longest_blank, "complete").otherwise("trailing_blank_block")
    return counts.withColumn("n_expected", F.lit(expected)).withColumn("trailing_blank_run", run).withColumn("status", status).drop("__last")


def score_totals(long: DataFrame, by: list[str], understand: str = "understand", produce: str = "produce", age: str | None = None) -> DataFrame:
    """Sums of both measures; a measure of which nothing was asked stays null."""
    total = lambda c: (F.coalesce(F.sum(c), F.lit(0)) if c in long.columns else F.lit(None).cast("long")).alias(f"total_{c}")
    return long.groupBy(*by).agg(total(understand), total(produce), *([F.min(age).alias(age)] if age else []))


def participant_analysis(criteria: DataFrame, totals: DataFrame, complete: DataFrame, key: str) -> DataFrame:
    """A form's criteria, scores and completeness, one row each."""
    from segflow.operators.joins import join_validated

    return join_validated(join_validated(criteria, totals, [key], validate="1:1"), complete, [key], validate="1:1")


def unknown_responses(long: DataFrame, unknown: str = "unknown") -> DataFrame:
    return long.where(F.col(unknown))


def item_proportions(long: DataFrame, by: list[str], value: str) -> DataFrame:
    return long.groupBy(*by).agg(F.count(value).alias("n_observed"), F.coalesce(F.sum(value), F.lit(0)).alias("n_endorsed"), F.avg(value).alias("proportion"))


def category_trajectories(long: DataFrame, participant: str, category: str, age: str, value: str) -> DataFrame:
    """Mean over participants of their means by category, and how many they are."""
    own = long.groupBy(participant, age, category).agg(F.avg(value).alias("proportion"))
    return own.groupBy(age, category).agg(F.avg("proportion").alias("mean_proportion"), F.count_distinct(participant).alias("n_participants"))


def representative_items(long: DataFrame, item: str, word: str, value: str, k: int = 6) -> DataFrame:
    """The ``k`` items answered nearest to half the time, of equal ones by word."""
    return long.groupBy(item, word).agg(F.avg(value).alias("proportion")).where("proportion IS NOT NULL").orderBy(F.abs(F.col("proportion") - 0.5), word, item).limit(k)


def most_observed(counts: DataFrame, word: str, n: str, k: int = 4) -> DataFrame:
    return counts.groupBy(word).agg(F.sum(n).alias("n")).orderBy(F.desc("n"), word).limit(k)


def items_n_by_age(long: DataFrame, item: str, wanted, age: str, included: str) -> DataFrame:
    return long.where((F.col(item) == wanted) & F.col(included)).groupBy(age).agg(F.count("*").alias("n"))
