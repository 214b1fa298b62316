"""Checks of schemas, keys, privacy and completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table does not keep what an operator needs."""


def require_columns(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ContractError(f"{label}: missing {missing}; found {df.columns}")
    return df


def assert_public(df: DataFrame, needed: str, forbidden: list[str]) -> DataFrame:
    require_columns(df, "public table", [needed])
    if private := [c for c in forbidden if c in df.columns]:
        raise ContractError(f"private columns in a public table: {private}")
    return df


def issue(df: DataFrame, key: str, kind: str, message: Column) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("participant_id"), F.lit(kind).alias("issue_type"), message.alias("message"))


def match_issues(expected: DataFrame, found: DataFrame, key: str, kind: str) -> DataFrame:
    """An issue for each expected key without a match."""
    return issue(expected.join(found.select(key).distinct(), key, "left_anti"), key, kind, F.lit(f"no match: {kind}"))


def short_recordings(df: DataFrame, key: str, hours: str, least: float) -> DataFrame:
    return issue(df.where(F.col(hours) < least), key, "short_recording", F.format_string(f"%.3f hours, fewer than {least:g}", F.col(hours).cast("double")))


def age_issues(df: DataFrame, key: str, days: str) -> DataFrame:
    missing = issue(df.where(F.col(days).isNull()), key, "missing_age", F.lit("no age"))
    return missing.union(issue(df.where(F.col(days) < 0), key, "negative_age", F.lit("age below zero")))


def unknown_labels(df: DataFrame, key: str, raw: str, mapped: Column) -> DataFrame:
    """An issue for each row whose label maps to nothing."""
    return issue(df.where(mapped.isNull()), key, "unknown_label", F.concat(F.lit("unknown label "), F.coalesce(F.col(raw), F.lit("null"))))


def validation_report(issues: DataFrame) -> DataFrame:
    names = ["participant_id", "issue_type", "message"]
    return issues.select(names).orderBy(*[F.asc_nulls_last(n) for n in names])


def zscore_checks(df: DataFrame, z: str, square: str, valid: Column | None = None, tolerance: float = 1e-9) -> DataFrame:
    """(check, passed): mean 0 and population deviation 1 over the (valid) rows, and the square's agreement."""
    rows = df if valid is None else df.where(valid)
    one = rows.agg(F.avg(z).alias("m"), F.stddev_pop(z).alias("s"), F.count(z).alias("n"), F.count_if(F.abs(F.col(square) - F.col(z) * F.col(z)) > tolerance).alias("off"))
    few = F.col("n") < 2
    checks = {"mean": few | (F.abs("m") < tolerance), "deviation": few | (F.abs(F.col("s") - 1) < tolerance), "square": F.col("off") == 0}
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("check"), F.coalesce(c, F.lit(False)).alias("passed")) for k, c in checks.items()])))


#: Ids are looked for by runs of so many characters without white space, shorter ones by all of theirs; longer words are cut into pieces of so many.
GRAM, PIECE = 8, 256


def _grams(word: Column, size: Column | int) -> Column:
    """The runs of ``size`` characters of a word of at most ``PIECE``."""
    size = F.lit(size) if isinstance(size, int) else size
    starts = F.sequence(F.lit(1), F.char_length(word) - size + 1)
    return F.when(F.char_length(word) >= size, F.transform(starts, lambda i: F.substr(word, i, size))).otherwise(F.array().cast("array<string>"))


def _pieces(text: Column) -> Column:
    """The distinct words of a text; long ones are cut into pieces that overlap by a run."""
    step = PIECE - GRAM + 1
    cut_up = lambda word: F.when(F.char_length(word) <= PIECE, F.array(word)).otherwise(F.transform(F.sequence(F.lit(1), F.char_length(word), F.lit(step)), lambda i: F.substr(word, i, F.lit(PIECE))))
    return F.array_distinct(F.flatten(F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), cut_up)))


def anchors(private: DataFrame, secret: str) -> DataFrame:
    """(secret, gram): for every id the run of its characters that fewest other ids have, of ``GRAM`` characters or a shorter word of the id."""
    ids = private.select(F.col(secret).cast("string").alias("secret")).distinct()
    words = ids.select("secret", F.explode(_pieces(F.col("secret"))).alias("word"))
    each = words.select("secret", F.explode(_grams(F.col("word"), F.least(F.char_length("word"), F.lit(GRAM)))).alias("gram")).distinct()
    shared = each.groupBy("gram").agg(F.count("*").alias("n"))
    return each.join(shared.hint("merge"), "gram").groupBy("secret").agg(F.min_by("gram", F.struct("n", -F.char_length("gram"), "gram")).alias("gram"))


def leak_scan(public: DataFrame, secrets: DataFrame, secret: str) -> DataFrame:
    """(column, n): how often a value of a public string column holds a private id anywhere in it, one count for a value and an id.

    Every id is found through one run of its characters that few ids share
    (``anchors``). Values are taken apart into words, each distinct word is
    looked up once by all its runs, and only values that have a word with an
    id's run are compared with that id. Values travel as two hashes until then,
    so long texts are not repeated. All joins are merged: the size of a packed
    file says little about its texts, so none is left to be broadcast by that.
    Null values hold nothing; null and blank ids
    are not looked for.
    """
    strings = [c for c, t in public.dtypes if t == "string"]
    none = public.sparkSession.createDataFrame([], "column string, n long")
    if not strings:
        return none
    values = public.select([F.col(c) for c in strings]).unpivot([], strings, "column", "value").where("value <> ''").withColumns({"h1": F.xxhash64("value"), "h2": F.xxhash64(F.lit(1), "value")})
    wanted = anchors(secrets, secret)
    sizes = [r["n"] for r in wanted.select(F.char_length("gram").alias("n")).distinct().collect()]  # at most GRAM numbers
    if not sizes:
        return none
    pieces = values.select("column", "h1", "h2", F.explode(_pieces(F.col("value"))).alias("piece"))
    looked_up = pieces.select("piece").distinct().select("piece", F.explode(F.flatten(F.array(*[_grams(F.col("piece"), n) for n in sizes]))).alias("gram"))
    found = looked_up.join(wanted.hint("merge"), "gram").select("piece", "secret").distinct()
    hits = pieces.join(found.hint("merge"), "piece").select("column", "h1", "h2", "secret").distinct()
    return values.join(hits.hint("merge"), ["column", "h1", "h2"]).where(F.contains("value", "secret")).groupBy("column").agg(F.count("*").alias("n"))


def format_consistency(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Groups whose parts disagree in a column."""
    counts = df.groupBy(by).agg(*[F.count_distinct(c).alias(c) for c in columns])
    return counts.where(" OR ".join(f"`{c}` > 1" for c in columns))


def output_completeness(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(present.select(keys).distinct(), keys, "left_anti")


def role_coverage(required: DataFrame, detected: DataFrame) -> DataFrame:
    """(role, files, ambiguous) of every required role; no files means that it is missing."""
    counts = detected.groupBy("role").agg(F.count("*").alias("files"), F.count_if("is_ambiguous").alias("ambiguous"))
    return required.join(counts, "role", "left").na.fill(0, ["files", "ambiguous"])


def subset_violations(df: DataFrame, understand: str, produce: str) -> DataFrame:
    """Rows that say more words than they understand."""
    return df.where(F.col(produce) > F.col(understand))


def grid_contract(grid: DataFrame, days: str, z: str, square: str, mean: float, deviation: float, tolerance: float = 1e-8) -> DataFrame:
    """(n_rows, z_off, square_off): rows of a grid whose z or its square disagree with the days."""
    wanted = (F.col(days) - mean) / deviation
    return grid.agg(F.count("*").alias("n_rows"), F.count_if(F.abs(F.col(z) - wanted) > tolerance).alias("z_off"), F.count_if(F.abs(F.col(square) - wanted * wanted) > tolerance).alias("square_off"))
