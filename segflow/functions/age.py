"""Ages, exposure and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days of a month in the cohort statistics and in the questionnaire.
STATS_MONTH, FORM_MONTH = 30.44, 30.4375
#: Age bounds of the two forms, in months.
FORM_1, FORM_2 = (8.0, 19.0), (19.0, 36.999999)


def age_days(reference: Column, birth: Column) -> Column:
    return F.datediff(reference, birth)


def age_months(reference: Column, birth: Column, days_per_month: float = STATS_MONTH) -> Column:
    return age_days(reference, birth) / F.lit(days_per_month)


def age_month(months: Column) -> Column:
    return F.floor(months).cast("int")


def age_discrepancy(reported: Column, exact: Column, limit: float = 2.0) -> Column:
    """(difference, flag): reported less exact months, and whether they differ by ``limit`` or more."""
    gap = reported - exact
    return F.struct(gap.alias("difference"), F.coalesce(F.abs(gap) >= limit, F.lit(False)).alias("flag"))


def expected_form(months: Column) -> Column:
    return F.when(months.isNull(), "unknown").when((months >= FORM_1[0]) & (months < FORM_1[1]), "CDI-I").when((months >= FORM_2[0]) & (months <= FORM_2[1]), "CDI-II").otherwise("out_of_range")


def age_is_valid(months: Column) -> Column:
    return F.coalesce(months.between(FORM_1[0], FORM_2[1]), F.lit(False))


def ordered_level(value: Column, levels: list[str]) -> Column:
    """Rank of a level from 1, null for unknown ones."""
    return F.nullif(F.array_position(F.array(*[F.lit(v) for v in levels]), value), F.lit(0)).cast("int")


def exposure(languages: list[tuple[Column, Column]], least: float = 75.0) -> Column:
    """(main_percent, unknown, invalid, passed) from (name, percent) of every further language.

    An unnamed language without a share has none; a named one without a share
    is unknown. The main language has what the others leave of 100 and must
    have more than ``least``.
    """
    named = [F.coalesce(F.trim(n), F.lit("")) != "" for n, _ in languages]
    unknown = F.array_contains(F.array(*[n & p.isNull() for n, (_, p) in zip(named, languages)]), True) if languages else F.lit(False)
    total = sum((F.coalesce(p, F.lit(0.0)) for _, p in languages), F.lit(0.0))
    negative = F.array_contains(F.array(*[F.coalesce(p < 0, F.lit(False)) for _, p in languages]), True) if languages else F.lit(False)
    main = 100.0 - total
    invalid = negative | (total > 100) | (main < 0)
    return F.struct(main.alias("main_percent"), unknown.alias("unknown"), invalid.alias("invalid"), ((main > least) & ~unknown & ~invalid).alias("passed"))


def transform_response(value: Column, how: str) -> Column:
    """log (of positive values), log1p (of non-negative ones) or the value itself; others are an error."""
    if how == "none":
        return value
    fits, made = {"log": (value > 0, F.ln(value)), "log1p": (value >= 0, F.log1p(value))}[how]
    return F.when(value.isNull() | fits, made).otherwise(F.raise_error(F.lit(f"{how} is not defined for a value")))


def inverse_response(value: Column, how: str) -> Column:
    return {"none": value, "log": F.exp(value), "log1p": F.expm1(value)}[how]


def bin_label(value: Column, edges: list[float]) -> Column:
    """Label ``[a,b)`` of the left-closed bin that holds the value; the last bin is open."""
    labels = [f"[{a:g},{b:g})" for a, b in zip(edges, edges[1:])] + [f"[{edges[-1]:g},inf)"]
    found = F.lit(None).cast("string")
    for low, label in zip(edges, labels):
        found = F.when(value >= low, label).otherwise(found)
    return found


def effect_direction(estimate: Column, low: Column, high: Column, near: float = 1e-8) -> Column:
    return F.when(low > 0, "above zero").when(high < 0, "below zero").when(F.abs(estimate) < near, "near zero").when(estimate > 0, "positive, interval holds zero").otherwise("negative, interval holds zero")
