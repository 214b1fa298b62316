"""Model matrices with factors and interactions, fits on their weighted sums of products, tests and intervals from the whole covariance."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations_with_replacement, product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segflow.operators.models import chi2_tail

#: A factor with more levels than this is refused: the driver holds a column for each.
MOST_LEVELS = 200
CONTRASTS = ("treatment", "sum")
Term = tuple[str, ...]


def factor_levels(df: DataFrame, factors: list[str]) -> dict[str, list]:
    """The sorted levels of each factor, nulls left out; one aggregate, which stops at ``MOST_LEVELS``."""
    if not factors:
        return {}
    counted = df.agg(*[F.approx_count_distinct(c, 0.01).alias(c) for c in factors]).first()
    if many := [c for c in factors if counted[c] > MOST_LEVELS]:
        raise ValueError(f"more than {MOST_LEVELS} levels in {many}")
    one = df.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in factors]).first()
    return {c: list(one[c]) for c in factors}


@dataclass
class Design:
    """The columns of a model matrix.

    ``terms`` are tuples of variables, one for a main effect, more for an
    interaction; variables in ``levels`` are factors, others numbers.
    ``treatment`` contrasts compare each level with the first, ``sum`` contrasts
    compare all but the last with the mean of all. An interaction's columns are
    products of its variables' columns, so the terms inside it belong in the
    model as well.
    """

    terms: list[Term]
    levels: dict[str, list] = field(default_factory=dict)
    contrasts: str = "treatment"

    def __post_init__(self) -> None:
        if self.contrasts not in CONTRASTS:
            raise ValueError(f"contrasts are one of {CONTRASTS}")
        for term in self.terms:
            for name in term:
                if len(term) > 1 and (name,) not in self.terms:
                    raise ValueError(f"{':'.join(term)} needs {name} in the model")

    @property
    def variables(self) -> list[str]:
        return list(dict.fromkeys(name for term in self.terms for name in term))

    def _coded(self, name: str) -> list[tuple[str, Column]]:
        x = F.col(name)
        if name not in self.levels:
            return [(name, x.cast("double"))]
        levels = self.levels[name]
        flag = lambda level: F.when(x == F.lit(level), 1.0)
        if self.contrasts == "treatment":
            return [(f"{name}[{v}]", F.when(x.isNotNull(), F.coalesce(flag(v), F.lit(0.0)))) for v in levels[1:]]
        return [(f"{name}[{v}]", F.when(x.isNotNull(), flag(v).when(x == F.lit(levels[-1]), -1.0).otherwise(0.0))) for v in levels[:-1]]

    def columns(self) -> list[tuple[Term, str, Column]]:
        """(term, name, column) of every column, the intercept first; a missing variable makes its columns null."""
        found: list[tuple[Term, str, Column]] = [((), "(intercept)", F.lit(1.0))]
        for term in self.terms:
            for parts in product(*[self._coded(name) for name in term]):
                found.append((term, ":".join(n for n, _ in parts), reduce(lambda a, b: a * b, [c for _, c in parts])))
        return found


@dataclass
class Fit:
    """Coefficients with their covariance; ``dispersion`` is the residual variance or a family's scale."""

    design: Design
    names: list[str]
    owners: list[Term]
    beta: np.ndarray
    cov: np.ndarray
    n: float
    dispersion: float
    rounds: int = 1

    @property
    def residual_df(self) -> int:
        return int(self.n) - int(np.linalg.matrix_rank(self.cov)) if len(self.beta) else int(self.n)


def _families() -> dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], tuple[Column, Column]], Callable[[Column], Column]]]:
    """For each family: the inverse link, (working weight, working step) of (y, mu), and the variance function."""
    return {
        "gaussian": (lambda eta: eta, lambda y, mu: (F.lit(1.0), y - mu), lambda mu: F.lit(1.0)),
        "gamma": (F.exp, lambda y, mu: (F.lit(1.0), y / mu - 1), lambda mu: mu * mu),
        "poisson": (F.exp, lambda y, mu: (mu, y / mu - 1), lambda mu: mu),
    }


def _solve(row, k: int, prefix: str = "m") -> np.ndarray:
    m = np.zeros((k, k))
    for i, j in combinations_with_replacement(range(k), 2):
        m[i, j] = m[j, i] = row[f"{prefix}{i}_{j}"] or 0.0
    return m


def fit_design(df: DataFrame, design: Design, y: str, family: str = "gaussian", tolerance: float = 1e-10, most_rounds: int = 50) -> Fit:
    """Fisher scoring on the model matrix: ``gaussian`` (identity link), ``gamma`` and ``poisson`` (log link).

    A round is one aggregate of the weighted sums of products of the columns
    and their products with the working steps, (p + 1)(p + 2) / 2 numbers
    however many rows there are; the coefficients enter the next one as
    literals. Gaussian models need one round. Rows with a missing variable or
    response are left out. Gamma responses must be positive, Poisson ones not
    negative: other rows are an error, not dropped.
    """
    inverse, working, variance = _families()[family]
    made = design.columns()
    k = len(made)
    xs = [f"x{i}" for i in range(k)]
    rows = df.select(*[c.alias(x) for x, (_, _, c) in zip(xs, made)], F.col(y).cast("double").alias("y")).na.drop()
    start = rows.agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.min("y").alias("least")).first()
    n = start["n"]
    if n and ((family == "gamma" and start["least"] <= 0) or (family == "poisson" and start["least"] < 0)):
        raise ValueError(f"a {family} response must be {'positive' if family == 'gamma' else 'zero or more'}; found {start['least']}")
    beta = np.zeros(k)
    beta[0] = 0.0 if not n or family == "gaussian" else math.log(max(start["mean"], 1e-300))
    pairs, rounds, gram, pearson = list(combinations_with_replacement(range(k), 2)), 0, np.zeros((k, k)), 0.0
    while n and rounds < most_rounds:
        eta = reduce(lambda a, b: a + b, [F.col(x) * float(b) for x, b in zip(xs, beta)])
        mu = inverse(eta)
        weight, step = working(F.col("y"), mu)
        at = rows.withColumns({"w": weight, "s": step, "e": (F.col("y") - mu) * (F.col("y") - mu) / variance(mu)})
        sums = at.agg(*[F.sum(F.col("w") * F.col(xs[i]) * F.col(xs[j])).alias(f"m{i}_{j}") for i, j in pairs], *[F.sum(F.col("w") * F.col(x) * F.col("s")).alias(f"g{i}") for i, x in enumerate(xs)], F.sum("e").alias("e")).first()
        gram, gradient, pearson = _solve(sums, k), np.array([sums[f"g{i}"] for i in range(k)]), sums["e"]
        change = np.linalg.pinv(gram, hermitian=True) @ gradient
        beta, rounds = beta + change, rounds + 1
        if family == "gaussian":
            pearson = max(pearson - float(change @ gradient), 0.0)  # what the step takes off the squares
            break
        if float(np.abs(change) @ np.sqrt(np.diag(gram))) <= tolerance * max(1.0, math.sqrt(n)):
            break
    rank = int(np.linalg.matrix_rank(gram, hermitian=True)) if n else 0
    scale = 1.0 if family == "poisson" else pearson / max(n - rank, 1)
    return Fit(design, [name for _, name, _ in made], [t for t, _, _ in made], beta, scale * np.linalg.pinv(gram, hermitian=True), float(n), scale, rounds)


def effects_table(spark, fit: Fit) -> DataFrame:
    """A row for each coefficient: estimate, se, statistic and the 1.96 se bounds."""
    se = np.sqrt(np.maximum(np.diag(fit.cov), 0))
    rows = [(n, float(b), float(s), float(b / s) if s else None, float(b - 1.96 * s), float(b + 1.96 * s), fit.n, float(fit.dispersion)) for n, b, s in zip(fit.names, fit.beta, se)]
    return spark.createDataFrame(rows, "term string, estimate double, se double, statistic double, low double, high double, n double, dispersion double")


def _beta_tail(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(1 - x, b, a)
    scale = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    total = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + top * d), 1 + top / c
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return scale * total


def f_tail(f: float, df1: float, df2: float) -> float:
    """Upper tail of the F distribution."""
    return 1.0 if f <= 0 else _beta_tail(df2 / (df2 + df1 * f), df2 / 2, df1 / 2)


def hypothesis(fit: Fit, term: Term, kind: int) -> np.ndarray:
    """The rows whose products with the coefficients a test of the term sets to 0.

    Type 3: the term's own coefficients, all others staying in the model. Type
    2: the term beside all terms that do not contain it. Its coefficients and
    those of the terms that contain it span a space; the tested directions in
    it are uncorrelated, by the covariance, with the containing terms' own.
    """
    one = np.eye(len(fit.beta))
    own = one[[i for i, t in enumerate(fit.owners) if t == term]]
    inside = one[[i for i, t in enumerate(fit.owners) if term and t != term and set(term) < set(t)]]
    if kind == 3 or not len(inside):
        return own
    both = np.vstack([inside, own])
    cross = inside @ fit.cov @ both.T
    _, weights, axes = np.linalg.svd(cross)
    rank = int((weights > 1e-10 * max(weights.max(), 1e-300)).sum())
    return axes[rank:] @ both


def term_tests(spark, fit: Fit, kind: int, test: str = "F") -> DataFrame:
    """(term, chi2, df, f, residual_df, p_value, anova_type) of every term; type 3 has the intercept as well.

    Wald statistics with the fit's covariance; ``test`` is ``F`` (the statistic
    for each degree of freedom) or ``chi2``. A term without estimable
    coefficients has df 0 and no p-value.
    """
    if kind not in (2, 3):
        raise ValueError("types are 2 and 3")
    rows = []
    for term in [*([()] if kind == 3 else []), *fit.design.terms]:
        rows_ = hypothesis(fit, term, kind)
        value, cov = rows_ @ fit.beta, rows_ @ fit.cov @ rows_.T
        df = int(np.linalg.matrix_rank(cov, hermitian=True)) if len(rows_) else 0
        chi2 = float(value @ np.linalg.pinv(cov, hermitian=True) @ value) if df else None
        p = None if not df else f_tail(chi2 / df, df, fit.residual_df) if test == "F" else chi2_tail(chi2, df)
        rows.append((":".join(term) or "(intercept)", chi2, df, chi2 / df if df else None, fit.residual_df, p, kind))
    return spark.createDataFrame(rows, "term string, chi2 double, df int, f double, residual_df long, p_value double, anova_type int")


def predict(grid: DataFrame, fit: Fit, inverse: Callable[[Column], Column] | None = None, width: float = 1.96) -> DataFrame:
    """Add ``fit``, ``se`` (on the model's scale), ``low`` and ``high`` to a table with the design's variables.

    The standard error is the quadratic form of the row with the whole
    covariance; fit and bounds then go back through ``inverse``, of the link or
    of the response's transform. Levels that the fit has not seen, and missing
    values, have no prediction.
    """
    back = inverse or (lambda c: c)
    made = fit.design.columns()
    known = [F.col(name).isin(values) for name, values in fit.design.levels.items() if name in fit.design.variables]
    usable = reduce(lambda a, b: a & b, known, F.lit(True))
    xs = [f"__x{i}" for i in range(len(made))]
    rows = grid.withColumns({x: c for x, (_, _, c) in zip(xs, made)})
    total = lambda parts: reduce(lambda a, b: a + b, parts)
    center = total([F.col(x) * float(b) for x, b in zip(xs, fit.beta)])
    spread = total([F.col(xs[i]) * F.col(xs[j]) * float(fit.cov[i, j] * (1 if i == j else 2)) for i, j in combinations_with_replacement(range(len(xs)), 2)])
    at = rows.withColumns({"__fit": F.when(usable, center), "se": F.when(usable, F.sqrt(F.greatest(spread, F.lit(0.0))))})
    return at.withColumns({"fit": back(F.col("__fit")), "low": back(F.col("__fit") - width * F.col("se")), "high": back(F.col("__fit") + width * F.col("se"))}).drop(*xs, "__fit")
