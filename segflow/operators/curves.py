"""Mean, quantile and polynomial curves from sums of products, so that a group of any size is many tasks."""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segflow.operators.norms import QUANTILES, basis_for, design, monotone_across_quantiles, quantile_fit
from segflow.operators.scans import ROWS_PER_RANGE, scan
from segflow.storage import cut

#: Distinct (age, score) pairs up to which one task fits a group's quantile curves; larger groups take a Spark aggregate a round.
PAIRS_PER_TASK = 500_000
#: Columns of a basis: four polynomials and up to two knots.
WIDTH = 6


def counted(df: DataFrame, names: list[str], age: str, score: str) -> DataFrame:
    """Rows counted by group, age and score; groups as text, null as empty."""
    keys = [F.coalesce(F.col(g).cast("string"), F.lit("")).alias(g) for g in names] or [F.lit("all").alias("group")]
    return df.where(F.col(age).isNotNull() & F.col(score).isNotNull()).groupBy(*keys, F.col(age).cast("double").alias("age"), F.col(score).cast("double").alias("score")).agg(F.count("*").alias("w"))


def shapes(rows: DataFrame, names: list[str], rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(group..., n, ages, low, high, knots): a line (knots null) for up to three ages, else up to two knots where the weights' running share passes even parts.

    The running weights are a carried scan over the ages, so the ages of one
    group may lie in many tasks.
    """
    by_age = rows.groupBy(*names, "age").agg(F.sum("w").alias("w"))
    whole = by_age.groupBy(*names).agg(F.sum("w").alias("n"), F.count("*").alias("ages"), F.min("age").alias("low"), F.max("age").alias("high"))
    inner = F.greatest(F.lit(3), F.least(F.lit(5), F.col("ages") - 1)) - 3
    walked = scan(by_age, names, ["age"], rows_per_range, last={"before_age": "age"}, total={"before": F.col("w")}).join(whole, names)
    marks = F.transform(F.sequence(F.lit(1), F.greatest(inner, F.lit(1)).cast("int")), lambda i: i / (inner + 1) * F.col("n"))
    passed = walked.where(inner > 0).select(*names, "age", "before_age", "before", "w", F.explode(marks).alias("mark")).where((F.col("mark") > F.col("before")) & (F.col("mark") <= F.col("before") + F.col("w")))
    knot = F.coalesce(F.col("before_age") + (F.col("mark") - F.col("before")) / F.col("w") * (F.col("age") - F.col("before_age")), F.col("age"))
    knots = passed.groupBy(*names).agg(F.array_sort(F.collect_list(knot)).alias("found"))
    return whole.join(knots, names, "left").select(*names, "n", "ages", "low", "high", F.when(F.col("ages") > 3, F.coalesce("found", F.array().cast("array<double>"))).alias("knots"))


def _place(age: Column) -> Column:
    return (F.least(F.greatest(age, F.col("low")), F.col("high")) - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-12))


def _legendre(t: Column) -> list[Column]:
    """Polynomials up to the third degree that are orthogonal on [0, 1]: the sums of their products are well conditioned."""
    return [F.lit(1.0), 2 * t - 1, 6 * t * t - 6 * t + 1, 20 * t * t * t - 30 * t * t + 12 * t - 1]


def spline_columns(age: Column) -> Column:
    """The basis at an age of a group with ``low, high, knots``; columns that the group's shape lacks are 0."""
    t, zero = _place(age), F.lit(0.0)
    one, two, three, four = _legendre(t)
    curved = lambda c: F.when(F.col("knots").isNull(), zero).otherwise(c)
    span = F.greatest(F.col("high") - F.col("low"), F.lit(1e-12))
    above = [F.coalesce(F.pow(F.greatest(t - (F.get("knots", F.lit(i)) - F.col("low")) / span, zero), F.lit(3.0)), zero) for i in range(WIDTH - 4)]
    return F.array(one, two, curved(three), curved(four), *above)


def poly_columns(age: Column) -> Column:
    """Polynomials of a degree below the group's number of ages, at most 3."""
    return F.array(*[F.when(F.lit(i) < F.col("ages"), c).otherwise(0.0) for i, c in enumerate(_legendre(_place(age)))])


def _products(weight: Column, width: int) -> list[Column]:
    x, y = F.col("x"), F.col("score")
    gram = [F.sum(weight * x[i] * x[j]) for i, j in combinations_with_replacement(range(width), 2)]
    return [F.array(*gram).alias("gram"), F.array(*[F.sum(weight * x[i] * y) for i in range(width)]).alias("cross")]


def _solver(width: int):
    """An Arrow UDF: coefficients of each row's normal equations, the least ones where columns are dependent."""
    at = list(combinations_with_replacement(range(width), 2))

    def solve(gram: pd.Series, cross: pd.Series) -> pd.Series:
        m = np.zeros((len(gram), width, width))
        for (i, j), v in zip(at, np.stack(gram.to_numpy()).T if len(gram) else []):
            m[:, i, j] = m[:, j, i] = v
        b = np.stack(cross.to_numpy()) if len(cross) else np.zeros((0, width))
        return pd.Series(list(np.einsum("gij,gj->gi", np.linalg.pinv(m, rcond=1e-13, hermitian=True), b)))

    solve.__annotations__ = {"gram": pd.Series, "cross": pd.Series, "return": pd.Series}
    return F.pandas_udf(solve, "array<double>")


def _dot(beta: Column, x: Column) -> Column:
    return F.aggregate(F.zip_with(beta, x, lambda b, v: b * v), F.lit(0.0), lambda a, v: a + v)


def _at(fitted: DataFrame, grid: Column, columns, top: float) -> DataFrame:
    """The fitted rows at every age of the grid, clipped to [0, top]."""
    spread = fitted.withColumn("age", F.explode(grid))
    return spread.withColumn("predicted", F.least(F.greatest(_dot(F.col("beta"), columns(F.col("age"))), F.lit(0.0)), F.lit(float(top))))


def _grid(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def mean_curves(df: DataFrame, age: str, score: str, grid: list[float], top: float, group: list[str] | None = None, least: int = 6) -> DataFrame:
    """(group..., age, predicted, method, n, r2): a cubic spline by least squares, clipped to [0, top].

    Rows enter through one aggregate of the weighted products of the basis; the
    systems of a row for each group are solved in Arrow batches. Groups of
    fewer than ``least`` rows or four ages get the medians by whole month.
    """
    names = group or ["group"]
    rows = counted(df, group or [], age, score)
    shaped = shapes(rows, names)
    few = (F.col("n") < least) | (F.col("ages") < 4)
    based = rows.join(shaped, names).where(~few).withColumn("x", spline_columns(F.col("age")))
    w, y = F.col("w"), F.col("score")
    sums = based.groupBy(*names).agg(*_products(w, WIDTH), F.sum(w * y * y).alias("yy"), F.sum(w * y).alias("sy"))
    fitted = sums.join(shaped, names).withColumn("beta", _solver(WIDTH)("gram", "cross"))
    whole = F.col("yy") - F.col("sy") * F.col("sy") / F.col("n")
    explained = _dot(F.col("beta"), F.col("cross")) - F.col("sy") * F.col("sy") / F.col("n")
    splines = _at(fitted.withColumn("r2", F.when(whole > 0, explained / whole).otherwise(float("nan"))), _grid(grid), spline_columns, top)
    medians = rows.join(shaped, names).where(few).groupBy(*names, F.floor("age").cast("double").alias("age"), "n").agg(F.percentile("score", 0.5, F.col("w")).alias("predicted"))
    columns = [*names, "age", "predicted"]
    return splines.select(*columns, F.lit("spline").alias("method"), F.col("n").cast("long").alias("n"), "r2").unionByName(medians.select(*columns, F.lit("median").alias("method"), F.col("n").cast("long").alias("n"), F.lit(float("nan")).alias("r2")))


def quantile_rounds(based: DataFrame, names: list[str], quantiles: tuple[float, ...], rounds: int = 100) -> DataFrame:
    """(group..., quantile, beta): quantile regression by reweighted least squares, a round being one aggregate of all groups and quantiles."""
    solve = _solver(WIDTH)
    first = based.groupBy(*names).agg(*_products(F.col("w"), WIDTH)).withColumn("beta", solve("gram", "cross"))
    state = cut(first.select(*names, F.explode(_grid(list(quantiles))).alias("quantile"), "beta", F.lit(False).alias("done")))
    for _ in range(rounds):
        if state.where(~F.col("done")).isEmpty():
            break
        gap = F.col("score") - _dot(F.col("beta"), F.col("x"))
        side = F.when(gap > 0, F.col("quantile")).otherwise(1 - F.col("quantile"))
        open_ = state.where(~F.col("done")).select(*names, "quantile", "beta")
        sums = based.join(open_, names).withColumn("weight", F.col("w") * side / F.greatest(F.abs(gap), F.lit(1e-4))).groupBy(*names, "quantile").agg(*_products(F.col("weight"), WIDTH)).withColumn("new", solve("gram", "cross"))
        moved = state.join(sums.select(*names, "quantile", "new"), [*names, "quantile"], "left")
        change = F.array_max(F.zip_with("new", "beta", lambda a, b: F.abs(a - b)))
        state = cut(moved.select(*names, "quantile", F.coalesce("new", "beta").alias("beta"), (F.col("done") | (change < 1e-8)).alias("done")))
    return state.select(*names, "quantile", "beta")


def quantile_curves(df: DataFrame, age: str, score: str, grid: list[float], top: float, quantiles: tuple[float, ...] = QUANTILES, group: list[str] | None = None, least: int = 20, pairs_per_task: int = PAIRS_PER_TASK, rounds: int = 100) -> DataFrame:
    """(group..., quantile, age, predicted, method): spline quantile curves that do not cross.

    Groups of up to ``pairs_per_task`` distinct (age, score) pairs are fitted
    each in one task; larger ones by aggregates (``quantile_rounds``), to the
    same coefficients. Small groups (``least`` rows, five ages) get the
    quantiles of their own scores.
    """
    names = group or ["group"]
    rows = counted(df, group or [], age, score)
    pairs = rows.groupBy(*names).agg(F.count("*").alias("pairs"), F.sum("w").alias("n"), F.count_distinct("age").alias("ages"))
    small = (F.col("n") < least) | (F.col("ages") < 5)
    own = rows.join(pairs.where(small), names).groupBy(*names).agg(F.percentile("score", _grid(list(quantiles)), F.col("w")).alias("q"))
    levels = F.arrays_zip(_grid(list(quantiles)).alias("quantile"), F.col("q").alias("level"))
    empirical = own.select(*names, F.explode(levels).alias("l"), F.lit("empirical").alias("method")).select(*names, F.col("l.quantile").alias("quantile"), F.explode(_grid(grid)).alias("age"), F.least(F.greatest(F.col("l.level"), F.lit(0.0)), F.lit(float(top))).alias("predicted"), "method")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, w = (pdf[c].to_numpy(float) for c in ("age", "score", "w"))
        shape = basis_for(x, w)
        at = np.clip(np.asarray(grid, float), shape[0], shape[1])
        levels = [design(at, shape) @ quantile_fit(design(x, shape), y, w, q, rounds) for q in quantiles]
        return pd.concat([pd.DataFrame({**{g: pdf[g].iloc[0] for g in names}, "quantile": q, "age": grid, "predicted": np.clip(v, 0, top), "method": "spline"}) for q, v in zip(quantiles, levels)])

    schema = ", ".join(f"`{g}` string" for g in names) + ", quantile double, age double, predicted double, method string"
    usual = rows.join(pairs.where(~small & (F.col("pairs") <= pairs_per_task)).select(*names), names).groupBy(*names).applyInPandas(fit, schema)
    large = cut(pairs.where(~small & (F.col("pairs") > pairs_per_task)).select(*names))
    curves = usual.unionByName(empirical)
    if not large.isEmpty():
        hot = rows.join(large, names)
        shaped = cut(shapes(hot, names))
        based = cut(hot.join(shaped, names).withColumn("x", spline_columns(F.col("age"))).select(*names, "score", "w", "x"))
        fitted = quantile_rounds(based, names, quantiles, rounds).join(shaped, names)
        curves = curves.unionByName(_at(fitted, _grid(grid), spline_columns, top).select(*names, "quantile", "age", "predicted", F.lit("spline").alias("method")))
    return monotone_across_quantiles(curves, [*names, "age"], "quantile", "predicted")


def preview_poly(df: DataFrame, age: str, score: str, top: float, points: int = 200, group: list[str] | None = None) -> DataFrame:
    """(group..., age, predicted): a polynomial of up to the third degree on an even grid, from one aggregate of products."""
    names = group or ["group"]
    rows = counted(df, group or [], age, score)
    whole = rows.groupBy(*names).agg(F.count_distinct("age").alias("ages"), F.min("age").alias("low"), F.max("age").alias("high"))
    based = rows.join(whole, names).withColumn("x", poly_columns(F.col("age")))
    fitted = based.groupBy(*names).agg(*_products(F.col("w"), 4)).join(whole, names).withColumn("beta", _solver(4)("gram", "cross"))
    even = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("low") + (F.col("high") - F.col("low")) * i / (points - 1))
    return _at(fitted, even, poly_columns, top).select(*names, "age", "predicted")
