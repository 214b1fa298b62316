"""Norm tables and age curves."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segflow.operators.quantiles import small_groups, with_quantiles

QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)


def included_rows(df: DataFrame, flag: str = "included_final") -> DataFrame:
    return df.where(F.coalesce(F.col(flag), F.lit(False)))


def _grouped(df: DataFrame, by: list[str], measure: str, quantiles: tuple[float, ...], approximate: bool, aggregates: list[Column]) -> DataFrame:
    """The groups' aggregates with ``__q``: exact quantiles in the same pass where no group is large, else by brackets; or approximate ones."""
    if approximate:
        return df.groupBy(*by).agg(*aggregates, F.percentile_approx(measure, list(quantiles), 10000).alias("__q"))
    if small_groups(df, by):
        return df.groupBy(*by).agg(*aggregates, F.percentile(measure, F.array(*[F.lit(x) for x in quantiles])).alias("__q"))
    return with_quantiles(df.groupBy(*by).agg(*aggregates), df, by, measure, quantiles, "__q")


def norm_table(df: DataFrame, age: str, measure: str, low: int, high: int, quantiles: tuple[float, ...] = QUANTILES, approximate: bool = False) -> DataFrame:
    """(age, n, mean, sd, min, max, p10...) for every month from ``low`` to ``high``, also those without rows.

    Quantiles interpolate linearly and are exact, also those of very large
    groups (``quantiles``), unless ``approximate``.
    """
    found = _grouped(df.where(F.col(measure).isNotNull()), [age], measure, quantiles, approximate, [F.count("*").alias("n"), F.avg(measure).alias("mean"), F.stddev_samp(measure).alias("sd"), F.min(measure).alias("min"), F.max(measure).alias("max")])
    grid = df.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias(age))
    return grid.join(found, age, "left").select(age, F.coalesce("n", F.lit(0)).alias("n"), "mean", "sd", "min", "max", *[F.col("__q")[i].alias(f"p{round(100 * q)}") for i, q in enumerate(quantiles)])


def grouped_norm_table(df: DataFrame, age: str, group: str, measure: str, quantiles: tuple[float, ...] = QUANTILES, approximate: bool = False) -> DataFrame:
    """Norms of the groups that occur, a null group included."""
    found = _grouped(df.where(F.col(measure).isNotNull()), [age, group], measure, (*quantiles, 0.5), approximate, [F.count("*").alias("n"), F.avg(measure).alias("mean"), F.min(measure).alias("min"), F.max(measure).alias("max")])
    return found.select(age, group, "n", "mean", F.col("__q")[len(quantiles)].alias("median"), "min", "max", *[F.col("__q")[i].alias(f"p{round(100 * q)}") for i, q in enumerate(quantiles)])


def age_counts(df: DataFrame, form: str, age: str) -> DataFrame:
    return df.groupBy(form, age).agg(F.count("*").alias("n"))


def group_median(df: DataFrame, age: str, group: str, measure: str) -> DataFrame:
    found = _grouped(df.where(F.col(group).isNotNull()), [age, group], measure, (0.5,), False, [F.count("*").alias("__n")])
    return found.select(age, group, F.col("__q")[0].alias("median"))


def sample_characteristics(df: DataFrame, form: str, age: str, share: str, categories: dict[str, list[str]]) -> DataFrame:
    """(form, characteristic, value): counts, ages and shares as text, and n (pct%) of fixed categories."""
    sd = lambda c: F.coalesce(F.format_string("%.2f", F.stddev_samp(c)), F.lit("NA"))
    mean_sd = lambda c: F.concat(F.format_string("%.2f", F.avg(c)), F.lit(" ("), sd(c), F.lit(")"))
    q = F.percentile(age, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    cells = {
        "N": F.count("*").cast("string"), f"{age} mean (sd)": mean_sd(age),
        f"{age} median [q1, q3]": F.format_string("%.2f [%.2f, %.2f]", q[1], q[0], q[2]),
        f"{age} range": F.format_string("%.2f-%.2f", F.min(age).cast("double"), F.max(age).cast("double")), f"{share} mean (sd)": mean_sd(share),
    }
    for column, values in categories.items():
        for v in values:
            n = F.count_if(F.lower(column) == v.lower())
            cells[f"{column}: {v}"] = F.format_string("%d (%.1f%%)", n, 100.0 * n / F.count("*"))
    one = df.groupBy(form).agg(*[c.alias(f"c{i}") for i, c in enumerate(cells.values())])
    return one.select(form, F.inline(F.array(*[F.struct(F.lit(n).alias("characteristic"), F.col(f"c{i}").alias("value")) for i, n in enumerate(cells)])))


def monotone_across_quantiles(df: DataFrame, by: list[str], quantile: str, prediction: str) -> DataFrame:
    """No prediction below that of a lower quantile at the same place."""
    order = Window.partitionBy(*by).orderBy(quantile).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(prediction, F.max(prediction).over(order))


def max_score(df: DataFrame, measure: str) -> DataFrame:
    return df.agg(F.max(measure).alias("max_score"))


# --- curves -----------------------------------------------------------------


def spline_basis(x: np.ndarray, low: float, high: float, knots: np.ndarray) -> np.ndarray:
    """Truncated-power cubic basis on [0, 1] of the clamped range, with the constant."""
    span = max(high - low, 1e-12)
    t = (np.clip(x, low, high) - low) / span
    k = (np.asarray(knots, float) - low) / span
    return np.column_stack([np.ones_like(t), t, t**2, t**3, *[np.maximum(t - a, 0) ** 3 for a in k]])


def basis_for(ages: np.ndarray, weights: np.ndarray) -> tuple[float, float, np.ndarray | None]:
    """(low, high, knots): 3 to 5 degrees of freedom by the number of ages, a line (no knots: None) for up to 3.

    Knots part the weights, added up by age, evenly, so they do not depend on the rows' order.
    """
    distinct, at = np.unique(ages, return_inverse=True)
    if len(distinct) <= 3:
        return float(distinct[0]), float(distinct[-1]), None
    inner = max(3, min(5, len(distinct) - 1)) - 3
    mass = np.cumsum(np.bincount(at, weights)) / weights.sum()
    knots = [float(np.interp((i + 1) / (inner + 1), mass, distinct)) for i in range(inner)]
    return float(distinct[0]), float(distinct[-1]), np.array(knots)


def design(x: np.ndarray, shape: tuple) -> np.ndarray:
    low, high, knots = shape
    return np.column_stack([np.ones_like(x), np.clip(x, low, high)]) if knots is None else spline_basis(x, low, high, knots)


def weighted_fit(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(x * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]


def quantile_fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, q: float, rounds: int = 100) -> np.ndarray:
    """Quantile regression by reweighted least squares of the check loss."""
    beta = weighted_fit(x, y, w)
    for _ in range(rounds):
        gap = y - x @ beta
        new = weighted_fit(x, y, w * np.where(gap > 0, q, 1 - q) / np.maximum(np.abs(gap), 1e-4))
        if np.abs(new - beta).max() < 1e-8:
            break
        beta = new
    return beta


def logistic_fit(x: np.ndarray, successes: np.ndarray, trials: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Binomial regression by Newton steps, slightly ridged."""
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hess = (x * (trials * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(x.shape[1])
        step = np.linalg.solve(hess, x.T @ (successes - trials * p) - 1e-6 * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def _collapsed(df: DataFrame, group: list[str], age: str, score: str) -> DataFrame:
    """Rows counted by group, age and score: as few rows as there are distinct values, whatever the input's size."""
    keys = [F.coalesce(F.col(g).cast("string"), F.lit("")).alias(g) for g in group] or [F.lit("all").alias("group")]
    return df.where(F.col(age).isNotNull() & F.col(score).isNotNull()).groupBy(*keys, F.col(age).cast("double").alias("age"), F.col(score).cast("double").alias("score")).agg(F.count("*").alias("w"))


def _apply(df: DataFrame, group: list[str], fit, columns: str) -> DataFrame:
    names = group or ["group"]
    return df.groupBy(*names).applyInPandas(fit, ", ".join(f"`{g}` string" for g in names) + ", " + columns)


def item_curves(df: DataFrame, item: str, age: str, value: str, grid: list[float], least: int = 20, positives: int = 3) -> DataFrame:
    """(item, age, predicted, method, insufficient_data): a binomial spline by item, or the means by month where data are few."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, w = (pdf[c].to_numpy(float) for c in ("age", "score", "w"))
        key, n, yes = pdf[item].iloc[0], w.sum(), (w * y).sum()
        if n < least or yes < positives or yes == n or len(np.unique(x)) < 2:
            months = np.floor(x)
            rows = [(m, float(np.average(y[months == m], weights=w[months == m]))) for m in np.unique(months)]
            return pd.DataFrame({item: key, "age": [r[0] for r in rows], "predicted": [r[1] for r in rows], "method": "mean", "insufficient_data": True})
        shape = basis_for(x, w)
        beta = logistic_fit(design(x, shape), w * y, w)
        at = np.clip(np.asarray(grid, float), shape[0], shape[1])
        return pd.DataFrame({item: key, "age": grid, "predicted": 1 / (1 + np.exp(-np.clip(design(at, shape) @ beta, -30, 30))), "method": "spline", "insufficient_data": False})

    return _apply(_collapsed(df, [item], age, value), [item], fit, "age double, predicted double, method string, insufficient_data boolean")
