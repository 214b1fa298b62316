"""Linked questionnaires: contacts, eligibility, exclusions, form detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segflow.functions.text import parse_yes_no

# The reasons, in the order in which they count, and the groups they are reported in.
REASONS = ("no_consent", "broken_reference_chain", "failed_eligibility", "hindi_exposure_unknown", "hindi_exposure_invalid", "hindi_exposure_leq_75", "age_outside_form_range", "age_form_mismatch", "incomplete_cdi")
GROUPS = {
    "no_consent": "No consent", "broken_reference_chain": "Broken reference chain", "failed_eligibility": "Failed eligibility", "hindi_exposure_leq_75": "Hindi exposure ≤75%",
    "hindi_exposure_unknown": "Hindi exposure unknown", "age_outside_form_range": "Age outside form range", "age_form_mismatch": "Age outside form range", "incomplete_cdi": "Incomplete CDI",
}


def _filled(column: str) -> Column:
    return F.nullif(F.trim(column), F.lit(""))


def contact_rollup(df: DataFrame, key: str, contact_id: str, created: str, mobile: str, email: str) -> DataFrame:
    """One row per key: rows, first id and time, first mobile and e-mail, all ids joined."""
    order = F.struct(F.col(created).isNull(), F.col(created), F.col(contact_id))
    first = lambda c: F.min_by(_filled(c), F.when(_filled(c).isNotNull(), order))
    return df.groupBy(key).agg(F.count("*").alias("n_contact_rows"), F.min_by(contact_id, order).alias("first_contact_id"), F.min(created).alias("first_created"), first(mobile).alias("mobile"), first(email).alias("email"), F.array_join(F.array_sort(F.collect_set(_filled(contact_id))), " | ").alias("contact_ids"))


def conflict_flags(df: DataFrame, key: str, mobile: str, email: str) -> DataFrame:
    counts = df.groupBy(key).agg(F.count("*").alias("n_rows"), F.count_distinct(_filled(mobile)).alias("n_mobiles"), F.count_distinct(_filled(email)).alias("n_emails"))
    return counts.withColumns({f"many_{n}": F.col(f"n_{n}") > 1 for n in ("rows", "mobiles", "emails")})


def link_counts(df: DataFrame, links: list[str], participant: str, contacts: str) -> DataFrame:
    """(metric, value): rows, linked rows by stage, participants, keys with several contacts."""
    one = df.agg(F.count("*").alias("rows"), *[F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(c) for c in links], F.count_distinct(participant).alias("participants"), F.count_if(F.col(contacts) > 1).alias("several_contacts"))
    return one.unpivot([], one.columns, "metric", "value")


def criteria(df: DataFrame, columns: dict[str, str], mother_tongue: bool = True, allow_preterm: bool = False, allow_impairment: bool = False) -> DataFrame:
    """Boolean columns of every criterion, ``eligibility_passed`` and ``included_final``.

    ``columns`` names the inputs: consent, mother_tongue, preterm, impairment
    and age_answer (yes/no answers as text or booleans), linked, exposure_ok,
    exposure_unknown, exposure_invalid, age_valid, age_form_match and, if forms
    can be incomplete, complete (booleans). A missing answer fails consent,
    mother tongue and age, and passes for health.
    """
    kinds = dict(df.dtypes)

    def answer(name: str) -> Column:
        column = columns[name]
        return parse_yes_no(F.col(column)) if kinds.get(column) == "string" else F.col(column)

    true = lambda c: F.coalesce(c, F.lit(False))
    given = lambda name: true(F.col(columns[name])) if name in columns else F.lit(True)
    flagged = df.withColumns({
        "consent_given": true(answer("consent")), "mother_tongue_passed": true(answer("mother_tongue") == mother_tongue),
        "preterm_allowed": F.lit(True) if allow_preterm else ~true(answer("preterm")), "impairment_allowed": F.lit(True) if allow_impairment else ~true(answer("impairment")),
        "age_answer_passed": true(answer("age_answer")), "linked": given("linked"), "exposure_unknown": given("exposure_unknown"), "exposure_invalid": given("exposure_invalid"),
        "exposure_passed": given("exposure_ok"), "age_passed": given("age_valid"), "age_form_passed": given("age_form_match"), "complete_enough": given("complete"),
    })
    eligible = F.col("mother_tongue_passed") & F.col("preterm_allowed") & F.col("impairment_allowed") & F.col("age_answer_passed")
    included = F.col("consent_given") & F.col("linked") & F.col("eligibility_passed") & F.col("exposure_passed") & F.col("age_passed") & F.col("age_form_passed") & F.col("complete_enough")
    return flagged.withColumn("eligibility_passed", eligible).withColumn("included_final", included)


def failing_criteria() -> dict[str, Column]:
    """For each reason, in their order, whether a row of ``criteria`` fails it."""
    known = ~F.col("exposure_unknown") & ~F.col("exposure_invalid")
    failed = [~F.col("consent_given"), ~F.col("linked"), ~F.col("eligibility_passed"), F.col("exposure_unknown"), F.col("exposure_invalid"), ~F.col("exposure_passed") & known, ~F.col("age_passed"), ~F.col("age_form_passed"), ~F.col("complete_enough")]
    return dict(zip(REASONS, failed))


def reasons(df: DataFrame, failing: dict[str, Column] | None = None) -> DataFrame:
    """Add ``all_reasons`` (joined) and ``primary_reason`` (the first, empty for none)."""
    failing = failing or failing_criteria()
    listed = F.array_compact(F.array(*[F.when(F.coalesce(m, F.lit(False)), F.lit(r)) for r, m in failing.items()]))
    return df.withColumn("__r", listed).withColumn("all_reasons", F.array_join("__r", "; ")).withColumn("primary_reason", F.coalesce(F.get("__r", F.lit(0)), F.lit(""))).drop("__r")


def flow_table(df: DataFrame, form: str, forms: list[str], stages: dict[str, Column]) -> DataFrame:
    """(stage_order, stage, one column for each form, total): rows that meet each mask, each on its own, in one pass."""
    one = df.agg(*[F.count_if(F.coalesce(m, F.lit(False)) & ((F.col(form) == f) if f else F.lit(True))).alias(f"s{i}_{j}") for i, m in enumerate(stages.values()) for j, f in enumerate([*forms, None])])
    rows = [F.struct(F.lit(i).alias("stage_order"), F.lit(s).alias("stage"), *[F.col(f"s{i}_{j}").alias(n) for j, n in enumerate([*forms, "total"])]) for i, s in enumerate(stages)]
    return one.select(F.inline(F.array(*rows)))


def exclusion_table(df: DataFrame, form: str, forms: list[str], reason: str = "primary_reason", groups: dict[str, str] | None = None) -> DataFrame:
    """(reason group, counts by form, total): every group of the list, 0 where none."""
    groups = GROUPS if groups is None else groups
    names = df.sparkSession.createDataFrame(list(groups.items()), "__reason string, exclusion string")
    counted = df.join(F.broadcast(names), F.col(reason) == F.col("__reason")).groupBy("exclusion").pivot(form, forms).agg(F.count(F.lit(1)))
    filled = names.select("exclusion").distinct().join(counted, "exclusion", "left").na.fill(0)
    return filled.withColumn("total", sum((F.col(f) for f in forms), F.lit(0)))


def duplicate_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """(n): rows that share their key with another row; null is a key like any other."""
    return df.groupBy(*keys).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c"))), F.lit(0)).alias("n"))


def detect_form_role(columns: DataFrame, rules: DataFrame) -> DataFrame:
    """Score every file against every role.

    ``columns`` has (file, column); ``rules`` has (role, role_order, form_id,
    column). A column found counts 1, the role's form id among the digit parts
    of the file's name 100. The best score above 0 wins, of equal ones the
    later role, and then the file is ambiguous.
    """
    roles = rules.select("role", "role_order", "form_id").distinct()
    files = columns.select("file").distinct()
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", "")
    hits = columns.join(rules, "column").groupBy("file", "role").agg(F.count("*").alias("hits"), F.array_sort(F.collect_set("column")).alias("matched"))
    scored = files.crossJoin(F.broadcast(roles)).join(hits, ["file", "role"], "left").withColumn("score", F.coalesce("hits", F.lit(0)) + F.when(F.array_contains(F.split(stem, "-"), F.col("form_id").cast("string")), 100).otherwise(0)).where("score > 0")
    best = Window.partitionBy("file").orderBy(F.desc("score"), F.desc("role_order"))
    ranked = scored.withColumn("r", F.row_number().over(best)).withColumn("is_ambiguous", F.count("*").over(Window.partitionBy("file", "score")) > 1)
    missing = rules.groupBy("role").agg(F.array_sort(F.collect_set("column")).alias("wanted"))
    chosen = ranked.where("r = 1").join(F.broadcast(missing), "role")
    none = F.array().cast("array<string>")
    return chosen.select("file", "role", "score", "is_ambiguous", F.array_join(F.coalesce("matched", none), " | ").alias("matched"), F.array_join(F.array_except("wanted", F.coalesce("matched", none)), " | ").alias("missing"))


def detection_report(columns: DataFrame, detected: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each file: its role or ``unknown``, what matched, and its size."""
    counts = columns.groupBy("file").agg(F.count("*").alias("n_columns"))
    return counts.join(detected, "file", "left").join(rows, "file", "left").withColumns({"role": F.coalesce("role", F.lit("unknown")), "score": F.coalesce("score", F.lit(0)), "is_ambiguous": F.coalesce("is_ambiguous", F.lit(False))})


def load_roles(detected: DataFrame, suffixes: tuple[str, ...] = ("xlsx", "txt", "csv")) -> DataFrame:
    """(role, file): one file for each role, by its suffix's place in the list, then by name."""
    rank = F.array_position(F.array(*[F.lit(s) for s in suffixes]), F.element_at(F.split("file", r"\."), -1))
    order = F.when(rank > 0, rank).otherwise(len(suffixes) + 1)
    return detected.groupBy("role").agg(F.min_by("file", F.struct(order, "file")).alias("file"))


def included_contacts(df: DataFrame, flag: str, columns: dict[str, str]) -> DataFrame:
    """The included rows' contact columns under their public names, for a private sink."""
    return df.where(F.coalesce(F.col(flag), F.lit(False))).select([F.col(c).alias(n) for c, n in columns.items()])
