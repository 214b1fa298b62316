"""Descriptive tables of any data."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segflow.functions.age import bin_label
from segflow.operators.quantiles import exact_quantiles, of_groups, with_quantiles


def _rows(one: DataFrame, rows: list[dict[str, Column]]) -> DataFrame:
    """A one-row table turned into several rows of expressions over it."""
    return one.select(F.inline(F.array(*[F.struct(*[c.alias(n) for n, c in r.items()]) for r in rows])))


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(variable, non_missing, mean, std, min, median, max); the deviation is the population's, the median exact."""
    each = [{"variable": F.lit(c)} | {s: F.col(f"{c}__{s}") for s in ("non_missing", "mean", "std", "min", "max")} for c in columns]
    cast = {c: F.col(c).try_cast("double") for c in columns}
    sums = [f(x).alias(f"{c}__{s}") for c, x in cast.items() for s, f in (("non_missing", F.count), ("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    medians = exact_quantiles(df, [], columns, (0.5,)).select("variable", F.col("q")[0].alias("median"))
    return _rows(df.agg(*sums), each).join(medians, "variable", "left").select("variable", "non_missing", "mean", "std", "min", "median", "max")


def missing_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(variable, missing, percent) of each column in one pass."""
    columns = columns or df.columns
    one = df.agg(F.count("*").alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return _rows(one, [{"variable": F.lit(c), "missing": F.col(c), "percent": F.when(F.col("__n") > 0, 100.0 * F.col(c) / F.col("__n"))} for c in columns])


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    """(value, n), null as ``missing``, most frequent first and equal ones by value."""
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("missing")).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def multi_distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """(type, value, n) of several columns."""
    return df.select([F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "type", "value").groupBy("type", F.coalesce("value", F.lit("missing")).alias("value")).agg(F.count("*").alias("n")).orderBy("type", "value")


def actual_vs_included(df: DataFrame, column: str, included: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("actual"), F.count_if(F.coalesce(F.col(included), F.lit(False))).alias("included"))


def mean_ci(df: DataFrame, by: list[str], column: str) -> DataFrame:
    sem = F.coalesce(F.stddev_samp(column) / F.sqrt(F.count(column)), F.lit(0.0))
    return df.groupBy(*by).agg(F.avg(column).alias("mean"), F.count(column).alias("n"), F.stddev_samp(column).alias("sd"), sem.alias("sem"), (1.96 * sem).alias("ci95"))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of all pairs in one pass, over the rows where both are there."""
    pairs = list(combinations_with_replacement(columns, 2))
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}__{b}") for a, b in pairs])
    both = {(a, b): f"{a}__{b}" for a, b in pairs} | {(b, a): f"{a}__{b}" for a, b in pairs}
    return _rows(one, [{"a": F.lit(a), "b": F.lit(b), "r": F.col(n)} for (a, b), n in both.items()])


def histogram(df: DataFrame, column: str) -> DataFrame:
    """(bin, low, high, n): between 5 and 20 equal bins, as many as distinct values."""
    x = F.col(column).cast("double")
    bounds = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.least(F.lit(20), F.greatest(F.lit(5), F.count_distinct(x))).alias("bins"))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.col("bins"), F.floor((x - F.col("lo")) / ((F.col("hi") - F.col("lo")) / F.col("bins"))) + 1)).otherwise(1)
    counts = df.where(x.isNotNull()).crossJoin(F.broadcast(bounds)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    grid = bounds.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("bins").cast("long"))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    return grid.join(counts, "bin", "left").select("bin", (F.col("lo") + (F.col("bin") - 1) * width).alias("low"), (F.col("lo") + F.col("bin") * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def box_stats(df: DataFrame, by: str, column: str) -> DataFrame:
    """Quartiles and whiskers: the farthest values within 1.5 interquartile ranges; groups without values have neither."""
    quartiles = of_groups(exact_quantiles(df, [by], [column], (0.25, 0.5, 0.75)).select(F.col(by).alias("__by"), "q"))
    reach = 1.5 * (F.col("q")[2] - F.col("q")[0])
    inside = F.when(F.col(column).between(F.col("q")[0] - reach, F.col("q")[2] + reach), F.col(column))
    joined = df.where(F.col(by).isNotNull()).join(quartiles, F.col(by) == F.col("__by"), "left")
    return joined.groupBy(by).agg(F.count(column).alias("n"), F.any_value(F.col("q")[0]).alias("q1"), F.any_value(F.col("q")[1]).alias("median"), F.any_value(F.col("q")[2]).alias("q3"), F.min(inside).alias("low"), F.max(inside).alias("high"))


def simple_fit(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n"))


def composition(df: DataFrame, by: str, column: str, classes: list[str], value: str) -> DataFrame:
    return df.groupBy(by).pivot(column, classes).agg(F.sum(value)).na.fill(0)


def duration_profile(df: DataFrame, duration: str, thresholds: list[float], quantiles: tuple[float, ...] = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    """(metric, value): count, mean, deviation, extremes, quantiles, and the share below each threshold."""
    d = F.col(duration)
    named = {"count": F.count(d).cast("double"), "mean": F.avg(d), "std": F.stddev_samp(d), "min": F.min(d), "max": F.max(d)}
    named |= {f"below_{t:g}": F.count_if(d < t).cast("double") for t in thresholds} | {f"pct_below_{t:g}": F.try_divide(100.0 * F.count_if(d < t), F.count(d)) for t in thresholds}
    found = exact_quantiles(df, [], [duration], quantiles).select(F.col("q").alias("__q"))
    one = df.agg(*[c.alias(n) for n, c in named.items()]).join(found, F.lit(True), "left")
    rows = {n: F.col(f"`{n}`") for n in named} | {f"p{100 * q:02.0f}": F.col("__q")[i] for i, q in enumerate(quantiles)}
    return _rows(one, [{"metric": F.lit(n), "value": c} for n, c in rows.items()])


def binned_profile(df: DataFrame, duration: str, edges: list[float]) -> DataFrame:
    """(bin, n, total_sec, mean_sec, median_sec, pct_n, pct_time) of every left-closed bin, also empty ones."""
    d = F.col(duration)
    rows = df.where(d.isNotNull()).select(bin_label(d, edges).alias("bin"), d.alias("__d"))
    sums = rows.groupBy("bin").agg(F.count("*").alias("n"), F.sum("__d").alias("total_sec"), F.avg("__d").alias("mean_sec"))
    found = with_quantiles(sums, rows, ["bin"], "__d", (0.5,), "__q").withColumn("median_sec", F.col("__q")[0]).drop("__q")
    labels = [f"[{a:g},{b:g})" for a, b in zip(edges, edges[1:])] + [f"[{edges[-1]:g},inf)"]
    grid = df.sparkSession.createDataFrame([(x,) for x in labels], "bin string")
    joined = grid.join(found, "bin", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "total_sec": F.coalesce("total_sec", F.lit(0.0))})
    total = joined.agg(F.sum("n").alias("__n"), F.sum("total_sec").alias("__t"))
    return joined.crossJoin(F.broadcast(total)).select("bin", "n", "total_sec", "mean_sec", "median_sec", F.when(F.col("__n") > 0, 100.0 * F.col("n") / F.col("__n")).alias("pct_n"), F.when(F.col("__t") > 0, 100.0 * F.col("total_sec") / F.col("__t")).alias("pct_time"))


def speaker_profile(df: DataFrame, by: list[str], duration: str) -> DataFrame:
    d = F.col(duration)
    sums = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(d).alias("total_sec"), F.avg(d).alias("mean_sec"), F.max(d).alias("max_sec"))
    found = with_quantiles(sums, df, by, duration, (0.5,), "__q").withColumn("median_sec", F.col("__q")[0])
    return found.select(*by, "n", "total_sec", "mean_sec", "median_sec", "max_sec").orderBy(F.desc("total_sec"), *by)


def overlap_share(pairs: DataFrame, segments: DataFrame, by: list[str], row_id: str) -> DataFrame:
    """(overlapping, total, share): distinct segments of either side of an overlap among all."""
    sides = pairs.select(*by, F.explode(F.array("first_id", "second_id")).alias(row_id)).distinct()
    return sides.agg(F.count("*").alias("overlapping")).crossJoin(segments.agg(F.count("*").alias("total"))).withColumn("share", F.when(F.col("total") > 0, F.col("overlapping") / F.col("total")))


def top_overlaps(pairs: DataFrame, k: int = 10) -> DataFrame:
    return pairs.orderBy(F.desc("overlap_sec"), "first_id", "second_id").limit(k)


def percent_of_total(df: DataFrame, value: str, name: str = "percent") -> DataFrame:
    total = df.agg(F.sum(value).alias("__total"))
    return df.crossJoin(F.broadcast(total)).withColumn(name, F.when(F.col("__total") != 0, 100.0 * F.col(value) / F.col("__total"))).drop("__total")


def response_metrics(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Count, extremes, mean, sample deviation, population skewness, zeros, and whether all are positive."""
    x = F.col(column).cast("double")
    x = F.when(~F.isnan(x), x)
    skew = F.when(F.count(x) >= 3, F.coalesce(F.skewness(x), F.lit(0.0)))
    return df.groupBy(*(by or [])).agg(F.count(x).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), skew.alias("skewness"), F.count_if(x == 0).alias("zeros"), F.bool_and(x > 0).alias("positive_only"))


def choose_family(metrics: DataFrame, transform: str = "log") -> DataFrame:
    """Add ``family``: what kind of model suits a response with these metrics."""
    cv = F.col("sd") / F.col("mean")
    mild = F.col("skewness").isNull() | ((F.abs("skewness") < 1) & (cv < 0.75))
    family = F.when(~F.col("positive_only"), "lmm").when(mild, "lmm").when(F.col("skewness") >= 2.5, "gamma").otherwise("gamma" if transform == "none" else "log_lmm")
    return metrics.withColumn("family", family)


def dataset_summary(frames: dict[str, DataFrame]) -> DataFrame:
    """(dataset, n_rows, n_columns)."""
    found = None
    for name, df in frames.items():
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("dataset"), "n_rows", F.lit(len(df.columns)).alias("n_columns"))
        found = one if found is None else found.union(one)
    return found


def trend(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Values at the least and greatest x, their difference and its direction."""
    ends = df.groupBy(*by).agg(F.min_by(y, x).alias("first"), F.max_by(y, x).alias("last")).withColumn("delta", F.col("last") - F.col("first"))
    return ends.withColumn("trend", F.when(F.abs("delta") < 1e-8, "flat").when(F.col("delta") > 0, "increasing").otherwise("decreasing"))


def value_sample(df: DataFrame, columns: list[str], k: int = 10, most: int = 25, by: str | None = None) -> DataFrame:
    """The first ``k`` distinct non-empty values of up to ``most`` columns, joined."""
    from segflow.functions.text import normalize_text

    long = df.select([normalize_text(F.col(c).cast("string")).alias(c) for c in columns[:most]]).unpivot([], columns[:most], "column", "value").where("value <> ''").distinct()
    return long.select("value").distinct().orderBy("value").limit(k).agg(F.array_join(F.array_sort(F.collect_list("value")), " | ").alias("sample"))
