"""Regression on sufficient statistics, intervals, evidence."""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segflow.operators.quantiles import exact_quantiles
from segflow.storage import cut

# --- distributions (series and continued fractions; no statistics library here) ---


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_tail(x: float, df: float) -> float:
    """Upper tail of the chi-square distribution by the incomplete gamma series or fraction."""
    if x <= 0:
        return 1.0
    a, half = df / 2, x / 2
    scale = math.exp(a * math.log(half) - half - math.lgamma(a))
    if half < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= half / n
            total += term
        return max(0.0, 1 - total * scale)
    b, c = half + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or 1e-300)
        c = (b + an / c) or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """Inverse of the normal distribution by bisection on its error function."""
    low, high = np.full(len(p), -40.0), np.full(len(p), 40.0)
    below = np.vectorize(lambda z: 0.5 * math.erfc(-z / math.sqrt(2)))
    for _ in range(80):
        middle = (low + high) / 2
        less = below(middle) < p
        low, high = np.where(less, middle, low), np.where(less, high, middle)
    return (low + high) / 2


# --- fits ---


def moments(df: DataFrame, x: list[str], y: str, by: list[str] | None = None) -> DataFrame:
    """Sums of products of the columns, the response and 1 by group: what the fits need of the rows, in one aggregate."""
    names = ["1", *x, y]
    col = {n: F.lit(1.0) if n == "1" else F.col(n).cast("double") for n in names}
    rows = df.na.drop(subset=[*x, y])
    return rows.groupBy(*(by or [])).agg(*[F.sum(col[a] * col[b]).alias(f"m{i}_{j}") for (i, a), (j, b) in combinations_with_replacement(list(enumerate(names)), 2)])


def _matrix(row, k: int) -> np.ndarray:
    m = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = row[f"m{i}_{j}"] or 0.0
    return m


def _effects(spark, names: list[str], beta: np.ndarray, cov: np.ndarray, extra: dict[str, float]) -> DataFrame:
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    rows = [(n, float(b), float(s), float(b / s) if s else None, float(b - 1.96 * s), float(b + 1.96 * s), *map(float, extra.values())) for n, b, s in zip(names, beta, se)]
    return spark.createDataFrame(rows, "term string, estimate double, se double, statistic double, low double, high double" + "".join(f", {k} double" for k in extra))


def least_squares(df: DataFrame, x: list[str], y: str) -> dict[str, np.ndarray | float]:
    """Coefficients (the intercept first), their covariance and the sums of squares, from one aggregate of (p + 2)^2 / 2 sums."""
    m = _matrix(moments(df, x, y).first(), len(x) + 2)
    xx, xy, yy, n = m[:-1, :-1], m[:-1, -1], m[-1, -1], m[0, 0]
    inverse = np.linalg.pinv(xx)
    beta = inverse @ xy
    left = max(yy - beta @ xy, 0.0)
    return {"beta": beta, "cov": left / max(n - len(beta), 1) * inverse, "left": left, "whole": yy - m[0, -1] ** 2 / n if n else 0.0, "n": n}


def fit_linear(df: DataFrame, x: list[str], y: str) -> DataFrame:
    """Least squares: a row per term with its interval, and n, r2, log-likelihood, AIC and BIC of the model."""
    fit = least_squares(df, x, y)
    n, left, whole, params = fit["n"], fit["left"], fit["whole"], len(x) + 2
    loglik = -n / 2 * (math.log(2 * math.pi * max(left / n, 1e-300)) + 1) if n else float("nan")
    return _effects(df.sparkSession, ["(intercept)", *x], fit["beta"], fit["cov"], {"n": n, "r2": 1 - left / whole if whole > 0 else float("nan"), "loglik": loglik, "aic": 2 * params - 2 * loglik, "bic": params * math.log(max(n, 1)) - 2 * loglik})


#: Variance ratios that a round of the profile likelihood tries, and its rounds: the last ones lie within 1e-5 of each other.
POINTS, ROUNDS, TOP_LOG = 64, 4, 6.0
#: The same of each simulation; every task sends this many rows for each of them.
SIM_POINTS, SIM_ROUNDS = 24, 5


def _best_ratios(shrunk, sims: int, points: int, rounds: int) -> dict[str, np.ndarray]:
    """Maximum likelihood of Gaussian models with one random intercept, a model for each simulation.

    For a ratio r of the variances, each group's matrix loses r / (1 + n r) of
    its sums' outer product; what is left is a linear model, and the profile
    likelihood has one dimension. ``shrunk(ratios)`` adds these matrices up
    over the groups, with log(1 + n r); each round looks between the
    neighbours of the best ratio so far.
    """
    logs, every = np.tile(np.append(-40.0, np.linspace(-12, TOP_LOG, points - 1)), (sims, 1)), np.arange(sims)
    for _ in range(rounds):
        ratios = np.where(logs > -30, np.exp(logs), 0.0)
        m, dets, n = shrunk(ratios)
        inverse = np.linalg.pinv(m[..., :-1, :-1])
        beta = np.einsum("spij,spj->spi", inverse, m[..., :-1, -1])
        left = np.maximum(m[..., -1, -1] - np.einsum("spi,spi->sp", beta, m[..., :-1, -1]), 1e-300)
        sigma2 = left / max(n, 1.0)
        loglik = -0.5 * (n * (np.log(2 * math.pi * sigma2) + 1) + dets)
        best = loglik.argmax(1)
        found = {name: v[every, best] for name, v in {"beta": beta, "inverse": inverse, "sigma2": sigma2, "loglik": loglik, "ratio": ratios}.items()}
        logs = np.linspace(logs[every, np.maximum(best - 1, 0)], logs[every, np.minimum(best + 1, points - 1)], points, axis=1)
    return found | {"n": n}


def _unpack(frame: pd.DataFrame, k: int, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Matrices and log determinants of (sim, point) rows; those without a row are 0."""
    m, dets = np.zeros((*shape, k, k)), np.zeros(shape)
    at = frame["sim"].to_numpy(int), frame["point"].to_numpy(int)
    for i, j in combinations_with_replacement(range(k), 2):
        m[(*at, i, j)] = m[(*at, j, i)] = frame[f"m{i}_{j}"].to_numpy(float)
    dets[at] = frame["dets"].to_numpy(float)
    return m, dets


def _fit_intercepts(groups: DataFrame, k: int) -> dict[str, np.ndarray | float]:
    """The model of the groups' moment matrices; a round is one aggregate, a row for each ratio comes back."""
    pairs, n, r = list(combinations_with_replacement(range(k), 2)), F.col("m0_0"), F.col("r")

    def shrunk(ratios: np.ndarray):
        tried = groups.select("*", F.posexplode(F.array(*[F.lit(float(v)) for v in ratios[0]])).alias("point", "r"))
        sums = [F.sum(F.col(f"m{i}_{j}") - r / (1 + n * r) * F.col(f"m0_{i}") * F.col(f"m0_{j}")).alias(f"m{i}_{j}") for i, j in pairs]
        frame = tried.groupBy("point").agg(*sums, F.sum(F.log1p(n * r)).alias("dets"), F.sum(n).alias("n")).toPandas().assign(sim=0)
        return *_unpack(frame, k, ratios.shape), float(frame["n"].max()) if len(frame) else 0.0

    fit = {name: v[0] if isinstance(v, np.ndarray) else v for name, v in _best_ratios(shrunk, 1, POINTS, ROUNDS).items()}
    return fit | {"tau2": fit["ratio"] * fit["sigma2"], "cov": fit["sigma2"] * fit["inverse"]}


def fit_random_intercept(df: DataFrame, x: list[str], y: str, group: str) -> DataFrame:
    """A row per term of the mixed model, with the variances and the likelihood.

    Groups (participants) stay a table of moments, a row for each; the driver
    sees their sums for some ratios of the variances, however many there are.
    """
    k = len(x) + 2
    groups = moments(df, x, y, [group]).persist()
    fit = _fit_intercepts(groups, k)
    groups.unpersist()
    params = k + 1
    return _effects(df.sparkSession, ["(intercept)", *x], fit["beta"], fit["cov"], {"sigma2": fit["sigma2"], "tau2": fit["tau2"], "n": fit["n"], "loglik": fit["loglik"], "aic": 2 * params - 2 * fit["loglik"], "bic": params * math.log(max(fit["n"], 1)) - 2 * fit["loglik"]})


#: Numbers of the draws that a task holds at a time.
DRAW_CELLS = 1 << 19


def _uniform(keys: np.ndarray, nsim: int, purpose: int) -> np.ndarray:
    """(group, simulation): numbers in (0, 1) that depend on the group's key, the simulation and the purpose alone."""
    h = keys[:, None] ^ (np.arange(nsim, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(purpose * 0xD1B54A32D192ED03 % 2**64))[None]
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(times)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54


def _normal(keys: np.ndarray, nsim: int, purpose: int) -> np.ndarray:
    return np.sqrt(-2 * np.log(_uniform(keys, nsim, 2 * purpose))) * np.cos(2 * math.pi * _uniform(keys, nsim, 2 * purpose + 1))


def _chisquare(keys: np.ndarray, nsim: int, free: np.ndarray) -> np.ndarray:
    """Chi-square draws of each group's degrees of freedom (0: none), by rejection from a cubed normal."""
    shape = np.tile((np.maximum(free, 1) / 2)[:, None], (1, nsim))
    d = np.where(shape < 1, shape + 1, shape) - 1 / 3
    found, wanted, attempt = np.zeros(d.shape), np.ones(d.shape, bool), 0
    while wanted.any():
        x, u = _normal(keys, nsim, 1_000 + 3 * attempt), _uniform(keys, nsim, 9_000_000 + attempt)
        v = (1 + x / np.sqrt(9 * d)) ** 3
        with np.errstate(divide="ignore", invalid="ignore"):
            taken = wanted & (v > 0) & (np.log(u) < 0.5 * x * x + d - d * v + d * np.log(np.where(v > 0, v, 1.0)))
        found, wanted, attempt = np.where(taken, d * v, found), wanted & ~taken, attempt + 1
    found = np.where(shape < 1, found * _uniform(keys, nsim, 8_999_999) ** (1 / shape), found)
    return np.where(free[:, None] > 0, 2 * found, 0.0)


def draw_products(m: np.ndarray, keys: np.ndarray, fit: dict, nsim: int) -> np.ndarray:
    """(group, simulation, column): the simulated response's products with the columns and itself, of groups given by their moment matrices.

    These are drawn from what the fitted model gives them: a normal intercept
    of the group, normal products along the columns' axes, and the rest of the
    squares as a chi-square.
    """
    xx, n = m[:, :-1, :-1], m[:, 0, 0]
    weights, axes = np.linalg.eigh(xx)
    kept = weights > 1e-9 * np.maximum(weights.max(1, keepdims=True), 1e-300)
    mean = np.tile(fit["beta"], (len(m), nsim, 1))
    mean[:, :, 0] += math.sqrt(fit["tau2"]) * _normal(keys, nsim, 0)
    z = np.stack([math.sqrt(fit["sigma2"]) * _normal(keys, nsim, 1 + i) for i in range(xx.shape[1])], axis=2) * kept[:, None]
    noise = np.einsum("gsi,gji->gsj", z * np.sqrt(np.maximum(weights, 0))[:, None], axes)
    projected = np.einsum("gsi,gij->gsj", mean, xx)
    squares = (projected * mean).sum(2) + 2 * (mean * noise).sum(2) + (z * z).sum(2)
    rest = fit["sigma2"] * _chisquare(keys, nsim, np.round(n) - kept.sum(1))
    return np.concatenate([projected + noise, (squares + rest)[:, :, None]], axis=2)


def shrunk_sums(m: np.ndarray, last: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(simulation, ratio, column, column) sums over groups of their matrices, each less its share of the sums' outer product; and the sums of log(1 + n r)."""
    n, k = m[:, 0, 0], m.shape[1]
    share = ratios[None] / (1 + n[:, None, None] * ratios[None])
    sums = np.zeros((*ratios.shape, k, k))
    first = m[:, 0, :-1]
    sums[..., :-1, :-1] = m[:, :-1, :-1].sum(0) - np.einsum("gsp,gi,gj->spij", share, first, first, optimize=True)
    sums[..., :-1, -1] = last[:, :, :-1].sum(0)[:, None] - np.einsum("gsp,gi,gs->spi", share, first, last[:, :, 0], optimize=True)
    sums[..., -1, :-1] = sums[..., :-1, -1]
    sums[..., -1, -1] = last[:, :, -1].sum(0)[:, None] - np.einsum("gsp,gs->sp", share, last[:, :, 0] ** 2)
    return sums, np.log1p(n[:, None, None] * ratios[None]).sum(0)


def bootstrap_ci(df: DataFrame, x: list[str], y: str, group: str, grid: list[dict[str, float]], nsim: int = 1000, seed: int = 1) -> DataFrame:
    """(grid_row, fit, low, high): predictions and their parametric bootstrap bounds.

    Simulated responses enter through the groups' sums alone, so rows are
    never repeated. Every simulation of every group is drawn once, in batches
    of groups, from hashes of the seed and the group, and stored; a round of the
    likelihood adds the stored draws up and sends a row for each simulation and
    tried ratio. The driver sees ``nsim`` times the tried ratios, whatever the
    number of groups; the work grows with groups times simulations.
    """
    k, spark = len(x) + 2, df.sparkSession
    pairs = list(combinations_with_replacement(range(k), 2))
    names = [f"m{i}_{j}" for i, j in pairs]
    groups = moments(df, x, y, [group]).withColumn("key", F.xxhash64(F.lit(seed), group)).persist()
    fit = _fit_intercepts(groups, k)
    at = np.array([[1.0, *[row[c] for c in x]] for row in grid])
    step = max(1, DRAW_CELLS // (nsim * max(k, SIM_POINTS)))

    def matrices(batch: pa.RecordBatch) -> np.ndarray:
        m = np.zeros((batch.num_rows, k, k))
        for i, j in pairs:
            m[:, i, j] = m[:, j, i] = batch.column(f"m{i}_{j}").to_numpy(zero_copy_only=False)
        return m

    def draw(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                made = draw_products(matrices(batch), batch.column("key").to_numpy().view(np.uint64), fit, nsim)
                ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * nsim * k)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.ListArray.from_arrays(ends, pa.array(made.ravel()))], names=[*names, "draws"])

    columns = ", ".join(f"{c} double" for c in names)
    drawn = cut(groups.select("key", *names).mapInArrow(draw, f"{columns}, draws array<double>"))
    groups.unpersist()

    def shrunk(ratios: np.ndarray):
        points = ratios.shape[1]

        def add(batches):
            sums, dets, seen = np.zeros((nsim, points, k, k)), np.zeros((nsim, points)), False
            for whole in batches:
                for start in range(0, whole.num_rows, step):
                    batch, seen = whole.slice(start, step), True
                    more, logs = shrunk_sums(matrices(batch), batch.column("draws").flatten().to_numpy().reshape(batch.num_rows, nsim, k), ratios)
                    sums, dets = sums + more, dets + logs
            if seen:
                sim, point = (v.ravel() for v in np.indices((nsim, points)))
                yield pa.RecordBatch.from_arrays([pa.array(sim), pa.array(point), pa.array(dets.ravel()), *[pa.array(np.ascontiguousarray(sums[:, :, i, j]).ravel()) for i, j in pairs]], names=["sim", "point", "dets", *names])

        parts = drawn.mapInArrow(add, f"sim long, point long, dets double, {columns}")
        return *_unpack(parts.groupBy("sim", "point").agg(*[F.sum(c).alias(c) for c in ("dets", *names)]).toPandas(), k, ratios.shape), fit["n"]

    values = _best_ratios(shrunk, nsim, SIM_POINTS, SIM_ROUNDS)["beta"] @ at.T
    rows = [(i, float(v), *(float(q) for q in np.quantile(values[:, i], (0.025, 0.975)))) for i, v in enumerate(at @ fit["beta"])]
    return spark.createDataFrame(rows, "grid_row int, fit double, low double, high double")


def prediction_grid(df: DataFrame, x: str, points: int, level: str, levels: list[str], fixed: dict[str, str]) -> DataFrame:
    """Even values of ``x`` with every level; other columns at their mode or mean, by one aggregate."""
    one = df.agg(F.min(x).cast("double").alias("__lo"), F.max(x).cast("double").alias("__hi"), *[(F.mode(c) if how == "mode" else F.avg(c)).alias(c) for c, how in fixed.items()])
    grid = one.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn(x, F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__i") / (points - 1))
    return grid.withColumn(level, F.explode(F.array(*[F.lit(v) for v in levels]))).drop("__lo", "__hi", "__i")


def interval(grid: DataFrame, fit: Column, se: Column, inverse=None) -> DataFrame:
    """fit +- 1.96 se on the model's scale, then back through ``inverse`` (the link's or the transform's)."""
    back = inverse or (lambda c: c)
    return grid.withColumns({"fit": back(fit), "low": back(fit - 1.96 * se), "high": back(fit + 1.96 * se)})


def gvif(correlations: dict[tuple[str, str], float], terms: dict[str, list[str]]) -> list[tuple[str, float, float, bool]]:
    """(term, gvif, adjusted, rank deficient) from the columns' correlations; a term may have several columns.

    A column that those before it determine is left out, and its term has no value; the others are judged without it.
    """
    columns = [c for cs in terms.values() for c in cs]
    r = np.array([[1.0 if a == b else correlations[a, b] for b in columns] for a in columns])
    det = lambda cs: float(np.linalg.det(r[np.ix_(cs, cs)])) if cs else 1.0
    kept: list[int] = []
    for i in range(len(columns)):
        if det([*kept, i]) > 1e-10 * det(kept):
            kept.append(i)
    found, at = [], 0
    for name, own in terms.items():
        inside, at = list(range(at, at + len(own))), at + len(own)
        if set(inside) - set(kept):
            found.append((name, float("nan"), float("nan"), True))
        else:
            value = det(inside) * det([i for i in kept if i not in inside]) / det(kept)
            found.append((name, value, value ** (1 / (2 * len(own))), False))
    return found


def gvif_table(df: DataFrame, terms: dict[str, list[str]]) -> DataFrame:
    from segflow.operators.profile import correlation_matrix

    columns = [c for cs in terms.values() for c in cs]
    pairs = {(r["a"], r["b"]): r["r"] for r in correlation_matrix(df, columns).collect()}
    return df.sparkSession.createDataFrame(gvif(pairs, terms), "term string, gvif double, adjusted double, rank_deficient boolean")


def wald_anova(df: DataFrame, terms: dict[str, list[str]], y: str) -> DataFrame:
    """(term, chi2, df, f, residual_df, p_value): Wald tests that all of a term's coefficients are 0, with their covariance.

    Without interactions these are the tests of types 2 and 3 alike; ``f`` is the statistic for each degree of freedom.
    """
    fit = least_squares(df, [c for cs in terms.values() for c in cs], y)
    made, at = [], 1
    for name, own in terms.items():
        beta, cov, at = fit["beta"][at : at + len(own)], fit["cov"][at : at + len(own), at : at + len(own)], at + len(own)
        chi2, rank = float(beta @ np.linalg.pinv(cov) @ beta), int(np.linalg.matrix_rank(cov))
        made.append((name, chi2, rank, chi2 / max(rank, 1), int(fit["n"]) - len(fit["beta"]), chi2_tail(chi2, rank) if rank else None))
    return df.sparkSession.createDataFrame(made, "term string, chi2 double, df int, f double, residual_df long, p_value double")


def residual_table(df: DataFrame, effects: DataFrame, x: list[str], y: str) -> DataFrame:
    """Rows with ``fitted`` and ``residual``; the few coefficients become literals."""
    beta = {r["term"]: r["estimate"] for r in effects.collect()}
    fitted = sum((F.col(c).cast("double") * beta[c] for c in x), F.lit(beta["(intercept)"]))
    return df.withColumn("fitted", fitted).withColumn("residual", F.col(y).cast("double") - F.col("fitted"))


def diagnostic_summary(residuals: DataFrame, x: list[str]) -> DataFrame:
    """(n, rmse, chi2, p): Breusch-Pagan's test that the squared residuals do not follow the columns."""
    squared = residuals.withColumn("__sq", F.col("residual") * F.col("residual"))
    first = fit_linear(squared, x, "__sq").first()
    chi2 = first["n"] * (first["r2"] if first["r2"] == first["r2"] else 0.0)
    p = chi2_tail(chi2, len(x))
    return squared.agg(F.count("residual").alias("n"), F.sqrt(F.avg("__sq")).alias("rmse")).withColumn("chi2", F.lit(float(chi2))).withColumn("p_value", F.lit(float(p)))


def heteroscedasticity(residuals: DataFrame, fitted: str = "fitted", residual: str = "residual") -> DataFrame:
    """(n, chi2, p_value): the score test that squared residuals do not grow or fall with the fitted values, by one aggregate.

    Half the squares that a line through the fitted values explains of the
    squared residuals over their mean; without any spread the test says nothing.
    """
    square = F.col(residual) * F.col(residual)
    sums = residuals.agg(F.count(residual).alias("n"), F.avg(square).alias("mean"), F.covar_pop(square, F.col(fitted)).alias("cov"), F.var_pop(F.when(F.col(residual).isNotNull(), F.col(fitted))).alias("var"))
    one = sums.select("n", F.when((F.col("mean") > 0) & (F.col("var") > 0), F.col("n") * F.col("cov") * F.col("cov") / F.col("var") / F.col("mean") / F.col("mean") / 2).alias("chi2")).first()
    p = None if one["chi2"] is None else chi2_tail(one["chi2"], 1)
    return residuals.sparkSession.createDataFrame([(one["n"], one["chi2"], p)], "n long, chi2 double, p_value double")


FLAGS = "model_class string, n long, singular_fit boolean, converged boolean, messages string, sigma2 double, tau2 double, heteroscedasticity_chi2 double, heteroscedasticity_p double"


def linear_flags(df: DataFrame, x: list[str], y: str) -> DataFrame:
    """The diagnostics of a linear model: singularity and convergence do not apply."""
    residuals = residual_table(df, fit_linear(df, x, y), x, y)
    test, fit = heteroscedasticity(residuals).first(), least_squares(df, x, y)
    return df.sparkSession.createDataFrame([("lm", int(fit["n"]), None, None, None, float(fit["left"] / max(fit["n"] - len(x) - 1, 1)), None, test["chi2"], test["p_value"])], FLAGS)


def mixed_flags(df: DataFrame, x: list[str], y: str, group: str, singular: float = 1e-4) -> DataFrame:
    """The diagnostics of a model with one random intercept.

    It is singular where the likelihood is best at the edge of no deviation
    between groups (their deviation over that within is below ``singular``),
    and has not converged where it still rises at the largest ratio tried or
    the columns are dependent. The residuals tested are the conditional ones:
    each group's intercept, shrunk by its size, is taken off as well.
    """
    k = len(x) + 2
    groups = moments(df, x, y, [group]).persist()
    try:
        fit = _fit_intercepts(groups, k)
        beta, ratio = [float(b) for b in fit["beta"]], float(fit["ratio"])
        messages = ["the deviation between groups has no upper bound"] * (ratio >= math.exp(TOP_LOG) * 0.99) + ["columns are dependent"] * (int(np.linalg.matrix_rank(fit["inverse"], hermitian=True)) < k - 1)
        n, left = F.col("m0_0"), F.col(f"m0_{k - 1}") - sum((F.col(f"m0_{i}") * b for i, b in enumerate(beta)), F.lit(0.0))
        shrunk = groups.select(group, (ratio / (1 + n * ratio) * left).alias("__shift"))
        rows = df.na.drop(subset=[*x, y]).alias("d").join(shrunk.alias("g"), F.col(f"d.{group}").eqNullSafe(F.col(f"g.{group}")))
        fitted = sum((F.col(f"d.{c}").cast("double") * b for c, b in zip(x, beta[1:])), F.lit(beta[0])) + F.col("__shift")
        test = heteroscedasticity(rows.select(fitted.alias("fitted"), (F.col(f"d.{y}").cast("double") - fitted).alias("residual"))).first()
    finally:
        groups.unpersist()
    found = ("lmm", int(fit["n"]), math.sqrt(ratio) < singular, not messages, "; ".join(messages) or None, float(fit["sigma2"]), float(fit["tau2"]), test["chi2"], test["p_value"])
    return df.sparkSession.createDataFrame([found], FLAGS)


def qq_points(residuals: DataFrame, column: str, points: int = 200) -> DataFrame:
    """(normal, sample): exact quantiles of the residuals beside the normal ones at (i - 0.5) / n."""
    shares = (np.arange(points) + 0.5) / points
    normal = normal_quantile(shares)
    one = exact_quantiles(residuals, [], [column], tuple(float(s) for s in shares)).select("q")
    return one.select(F.inline(F.arrays_zip(F.array(*[F.lit(float(z)) for z in normal]).alias("normal"), F.col("q").alias("sample"))))


def selection_table(metrics: DataFrame, response: str, terms: list[str], engine: str) -> DataFrame:
    """A registry row for each model: its response, family, terms and engine."""
    return metrics.select("*", F.lit(response).alias("response"), F.lit(", ".join(terms)).alias("terms"), F.lit(engine).alias("engine"), F.lit("fitted").alias("status"))


def focal_effects(effects: DataFrame, rules: DataFrame) -> DataFrame:
    """Effects whose term meets a family's pattern; rules are (family, pattern), few and broadcast."""
    return effects.join(F.broadcast(rules), F.rlike(effects["term"], rules["pattern"])).drop("pattern")


def evidence(effects: DataFrame, by: str, positive: bool = True) -> DataFrame:
    """(by, category): how firmly the focal effects of a model support a hypothesis, positive or of either sign.

    Effects that point the same way are strong, moderate or weak evidence;
    others are inconsistent with it if their intervals exclude zero. A missing number decides nothing.
    """
    all_of = lambda c: F.coalesce(F.bool_and(c), F.lit(True))
    same = all_of(F.col("estimate") > 0) if positive else F.lit(True)
    off_zero, strong = all_of((F.col("low") > 0) | (F.col("high") < 0)), all_of(F.abs(F.col("estimate") / F.col("se")) >= 2.5)
    sums = effects.groupBy(by).agg(same.alias("same"), off_zero.alias("off"), strong.alias("strong"))
    supports = F.when(F.col("off") & F.col("strong"), "Strong").when(F.col("off"), "Moderate").otherwise("Weak")
    category = F.when(F.col("same"), F.concat(supports, F.lit(" evidence supporting the hypothesis"))).when(F.col("off"), "Evidence inconsistent with the hypothesis").otherwise("Inconclusive evidence")
    return sums.select(by, category.alias("category"))
