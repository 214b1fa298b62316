"""Contrasts, tests of types 2 and 3, gamma fits and intervals against numpy on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from segflow.operators import design

TERMS = [("age",), ("sex",), ("age", "sex"), ("site",)]


def table(spark, balanced):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(240):
        sex, site = ("f", "m")[i % 2], "pqr"[i // 2 % 3]
        if not balanced and (sex == "m" and site == "r" or rng.random() < 0.2):
            continue
        age = float(i // 6 % 10) if balanced else rng.uniform(1, 10) + (sex == "m")
        rows.append((age, sex, site, 2 + 0.5 * age + (sex == "m") * (1 - 0.2 * age) + "pqr".index(site) + rng.normal()))
    rows += [(None, "f", "p", 1.0), (1.0, None, "p", 1.0), (1.0, "f", "p", None)]
    return spark.createDataFrame(rows, "age double, sex string, site string, y double"), [r for r in rows if None not in r]


def matrix(rows, terms, contrasts):
    """(columns, owners) by hand."""
    def coded(name, r):
        if name == "age":
            return [r[0]]
        levels, v = (["f", "m"], r[1]) if name == "sex" else (["p", "q", "r"], r[2])
        if contrasts == "treatment":
            return [float(v == x) for x in levels[1:]]
        return [-1.0 if v == levels[-1] else float(v == x) for x in levels[:-1]]

    out, owners = [], []
    for r in rows:
        line, owners = [1.0], [()]
        for t in terms:
            cols = coded(t[0], r)
            for name in t[1:]:
                cols = [a * b for a in cols for b in coded(name, r)]
            line += cols
            owners += [t] * len(cols)
        out.append(line)
    return np.array(out), owners


def rss(x, y):
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    return float(((y - x @ beta) ** 2).sum())


@pytest.mark.parametrize("contrasts", ["treatment", "sum"])
@pytest.mark.parametrize("balanced", [True, False])
def test_fit_and_tests(spark, contrasts, balanced):
    df, rows = table(spark, balanced)
    fit = design.fit_design(df, design.Design(TERMS, design.factor_levels(df, ["sex", "site"]), contrasts), "y")
    x, owners = matrix(rows, TERMS, contrasts)
    y = np.array([r[3] for r in rows])
    assert fit.owners == owners and fit.n == len(rows)
    assert np.allclose(fit.beta, np.linalg.lstsq(x, y, rcond=None)[0])
    sigma2 = rss(x, y) / (len(y) - x.shape[1])
    assert np.allclose(fit.cov, sigma2 * np.linalg.inv(x.T @ x))
    found = {(r.anova_type, r.term): r for kind in (2, 3) for r in design.term_tests(spark, fit, kind).collect()}
    for term in TERMS:
        keep = [i for i, t in enumerate(owners) if not (set(term) < set(t))]
        without = [i for i in keep if owners[i] != term]
        two = (rss(x[:, without], y) - rss(x[:, keep], y)) / sigma2
        three = (rss(x[:, [i for i, t in enumerate(owners) if t != term]], y) - rss(x, y)) / sigma2
        name = ":".join(term)
        assert found[2, name].chi2 == pytest.approx(two, rel=1e-6, abs=1e-6) and found[3, name].chi2 == pytest.approx(three, rel=1e-6, abs=1e-6)
        assert found[2, name].df == owners.count(term) and found[2, name].residual_df == len(y) - x.shape[1]
    same = found[2, "sex"].chi2 == pytest.approx(found[3, "sex"].chi2, rel=1e-3)
    assert not same  # the interaction with age sets them apart
    assert (3, "(intercept)") in found and (2, "(intercept)") not in found


def test_tails():
    assert design.f_tail(4.0, 1, 10) == pytest.approx(0.0734, abs=5e-5)
    assert design.f_tail(3.0, 2, 5) == pytest.approx((1 + 2 * 3 / 5) ** -2.5)
    assert design.f_tail(1.0, 4, 4) == pytest.approx(0.5)


def test_predictions_use_the_whole_covariance(spark):
    df, rows = table(spark, False)
    made = design.Design(TERMS, design.factor_levels(df, ["sex", "site"]), "sum")
    fit = design.fit_design(df, made, "y")
    grid = spark.createDataFrame([(3.0, "m", "q"), (9.0, "f", "r"), (1.0, "m", "z"), (None, "m", "q")], "age double, sex string, site string")
    found = design.predict(grid, fit, F.exp).collect()
    at, _ = matrix([(3.0, "m", "q"), (9.0, "f", "r")], TERMS, "sum")
    for r, line in zip(found, at):
        eta, se = line @ fit.beta, math.sqrt(line @ fit.cov @ line)
        assert r.se == pytest.approx(se) and r.fit == pytest.approx(math.exp(eta)) and r.low == pytest.approx(math.exp(eta - 1.96 * se)) and r.high == pytest.approx(math.exp(eta + 1.96 * se))
    assert found[2].fit is None and found[3].fit is None


def test_gamma_equals_sparks_own(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    rng = np.random.default_rng(2)
    rows = [(float(a), float(b), float(rng.gamma(3.0) * math.exp(0.3 + 0.2 * a - 0.5 * b))) for a, b in zip(rng.uniform(0, 5, 500), rng.uniform(0, 2, 500))]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    fit = design.fit_design(df, design.Design([("a",), ("b",)]), "y", "gamma")
    model = GeneralizedLinearRegression(family="gamma", link="log", featuresCol="v", labelCol="y", tol=1e-12, maxIter=100).fit(VectorAssembler(inputCols=["a", "b"], outputCol="v").transform(df))
    assert np.allclose(fit.beta, [model.intercept, *model.coefficients])
    errors = model.summary.coefficientStandardErrors
    assert np.allclose(np.sqrt(np.diag(fit.cov)), [errors[-1], *errors[:-1]], rtol=1e-5) and fit.dispersion == pytest.approx(model.summary.dispersion, rel=1e-5)
    with pytest.raises(ValueError):
        design.fit_design(df.withColumn("y", F.col("y") - 100), design.Design([("a",)]), "y", "gamma")


def test_poisson_and_edges(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 4.0), ("b", 0.0), ("b", 5.0)], "g string, y double")
    fit = design.fit_design(df, design.Design([("g",)], design.factor_levels(df, ["g"])), "y", "poisson")
    assert np.allclose(fit.beta, [math.log(2), math.log(1.5)]) and np.allclose(np.diag(fit.cov), [1 / 4, 1 / 4 + 1 / 9])
    with pytest.raises(ValueError):
        design.Design([("age", "sex")])
    empty = design.fit_design(df.limit(0), design.Design([("g",)], {"g": ["a", "b"]}), "y")
    assert empty.n == 0 and design.term_tests(spark, empty, 2).first()["df"] == 0


def test_report_has_nine_tables(spark, tmp_path):
    from segflow.plans import report

    df, rows = table(spark, False)
    df = df.withColumn("pos", F.exp(F.col("y") / 10))
    specs = [report.ModelSpec("y", (("age",), ("sex",), ("age", "sex")), anova_type=3), report.ModelSpec("pos", (("age",), ("site",)), family="gamma"), report.ModelSpec("age", (("sex",),), "log")]
    grid = spark.createDataFrame([(3.0, "m", "q"), (6.0, "f", "p")], "age double, sex string, site string")
    focal = spark.createDataFrame([("ages", "^age$")], "family string, pattern string")
    questions = spark.createDataFrame([("does it grow?", ["y"]), ("is it there?", ["pos", "y"]), ("other?", ["age"])], "question string, response_keys array<string>")
    paths = report.publish_report(df, specs, grid, focal, questions, str(tmp_path))
    assert set(paths) == {*report.TABLES, "predictions_y", "predictions_pos", "predictions_age"}
    read = {n: spark.read.parquet(p) for n, p in paths.items()}
    manifest = {r.response: r.path for r in read["prediction_manifest"].collect()}
    assert manifest == {s.response: paths[f"predictions_{s.response}"] for s in specs}
    assert {(r.response, r.term) for r in read["anova_summary"].collect()} == {("y", "(intercept)"), ("y", "age"), ("y", "sex"), ("y", "age:sex"), ("pos", "age"), ("pos", "site"), ("age", "sex")}
    answers = {r.question: r.category for r in read["research_question_summary"].collect()}
    assert answers["does it grow?"].endswith("supporting the hypothesis") and answers["other?"] == "Inconclusive evidence"
    shown = {r.response: r for r in read["diagnostics_summary"].collect()}
    assert shown["y"].n_complete_cases == len(rows) and shown["pos"].model_class == "glm" and all(r.converged for r in shown.values())
    fit = report.fit_model(df, specs[2])
    at = read["predictions_age"].where("sex = 'm'").first()
    assert at.fit == pytest.approx(math.exp(fit.beta[0] + fit.beta[1])) and at.low < at.fit < at.high
    assert read["dataset_summary"].count() == 2 and read["model_selection_summary"].count() == 3 and read["collinearity_summary"].count() == 6
