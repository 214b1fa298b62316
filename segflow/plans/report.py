"""The report of a set of models: nine tables, published together, with the fits and the data's scans shared."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segflow.functions.age import inverse_response, transform_response
from segflow.operators import design, joins, models, profile
from segflow.sources.files import Node, publish_nodes

#: The report's tables, in the order in which they are read.
TABLES = ("dataset_summary", "model_selection_summary", "fixed_effects_summary", "evidence_summary", "research_question_summary", "diagnostics_summary", "anova_summary", "collinearity_summary", "prediction_manifest")


@dataclass(frozen=True)
class ModelSpec:
    """A response with its transform (``none``, ``log``, ``log1p``), family and terms; type 3 tests take sum contrasts, type 2 treatment contrasts."""

    response: str
    terms: tuple[design.Term, ...]
    transform: str = "none"
    family: str = "gaussian"
    anova_type: int = 2


def _rows(data: DataFrame, spec: ModelSpec) -> DataFrame:
    """The data with the transformed response as ``__y``."""
    y = F.col(spec.response) if spec.transform == "none" else transform_response(F.col(spec.response), spec.transform)
    return data.withColumn("__y", y)


def fit_model(data: DataFrame, spec: ModelSpec) -> design.Fit:
    factors = [f.name for f in data.schema if f.dataType.simpleString() in ("string", "boolean") and any(f.name in t for t in spec.terms)]
    made = design.Design(list(spec.terms), design.factor_levels(data, factors), "sum" if spec.anova_type == 3 else "treatment")
    return design.fit_design(_rows(data, spec), made, "__y", spec.family)


def collinearity(data: DataFrame, fit: design.Fit) -> DataFrame:
    """Generalised variance inflation of the terms' columns."""
    columns = [(t, n, c) for t, n, c in fit.design.columns() if t]
    table = data.select(*[c.alias(f"c{i}") for i, (_, _, c) in enumerate(columns)]).na.drop()
    terms: dict[str, list[str]] = {}
    for i, (t, _, _) in enumerate(columns):
        terms.setdefault(":".join(t), []).append(f"c{i}")
    return models.gvif_table(table, terms)


def predictions(grid: DataFrame, spec: ModelSpec, fit: design.Fit) -> DataFrame:
    """The grid with fit and bounds on the response's own scale."""
    back: Callable = F.exp if spec.family in ("gamma", "poisson") else (lambda c: c)
    return design.predict(grid, fit, lambda c: inverse_response(back(c), spec.transform) if spec.transform != "none" else back(c))


def diagnostics(data: DataFrame, spec: ModelSpec, fit: design.Fit) -> DataFrame:
    """(n_complete_cases, model_class, heteroscedasticity): Pearson residuals against fitted values on the model's scale."""
    at = design.predict(_rows(data, spec), fit).where(F.col("__y").isNotNull() & F.col("fit").isNotNull())
    mean = F.exp("fit") if spec.family in ("gamma", "poisson") else F.col("fit")
    scale = {"gamma": mean, "poisson": F.sqrt(mean)}.get(spec.family, F.lit(1.0))
    test = models.heteroscedasticity(at.select(F.col("fit").alias("fitted"), ((F.col("__y") - mean) / scale).alias("residual")))
    kind = "lm" if spec.family == "gaussian" else "glm"
    return test.select(F.lit(kind).alias("model_class"), F.col("n").alias("n_complete_cases"), F.lit(fit.rounds < 50).alias("converged"), F.col("chi2").alias("heteroscedasticity_chi2"), F.col("p_value").alias("heteroscedasticity_p"))


def publish_report(data: DataFrame, specs: list[ModelSpec], grid: DataFrame, focal: DataFrame, questions: DataFrame, root: str) -> dict[str, str]:
    """Fit every model once and write the nine tables, and each model's predictions; returns the paths.

    ``grid`` has the terms' variables; ``focal`` (family, pattern) chooses the
    effects that are evidence; ``questions`` (question, response_keys) are
    linked to the evidence of their responses, also those without any.
    """
    spark = data.sparkSession
    fits = {s.response: fit_model(data, s) for s in specs}
    every = lambda make: reduce(lambda a, b: a.unionByName(b), [make(s, fits[s.response]).withColumn("response", F.lit(s.response)) for s in specs])
    terms = lambda s: [":".join(t) for t in s.terms]
    effects = every(lambda s, f: design.effects_table(spark, f))
    nodes = {
        "effects": Node(lambda: effects),
        "dataset_summary": Node(lambda: profile.dataset_summary({"data": data, "grid": grid})),
        "model_selection_summary": Node(lambda: every(lambda s, f: models.selection_table(profile.choose_family(profile.response_metrics(data, s.response), s.transform), s.response, terms(s), s.family))),
        "fixed_effects_summary": Node(lambda e: e, ("effects",)),
        "evidence_summary": Node(lambda e: models.evidence(models.focal_effects(e, focal), "response"), ("effects",)),
        "research_question_summary": Node(lambda e: joins.link_questions(questions, e.withColumnRenamed("response", "response_key")), ("evidence_summary",)),
        "diagnostics_summary": Node(lambda: every(lambda s, f: diagnostics(data, s, f))),
        "anova_summary": Node(lambda: every(lambda s, f: design.term_tests(spark, f, s.anova_type, "F" if s.family == "gaussian" else "chi2"))),
        "collinearity_summary": Node(lambda: every(lambda s, f: collinearity(data, f))),
        "prediction_manifest": Node(lambda: spark.createDataFrame([(s.response, f"{root}/predictions/predictions_{s.response}") for s in specs], "response string, path string")),
    } | {f"predictions_{s.response}": Node(lambda s=s: predictions(grid, s, fits[s.response])) for s in specs}
    return publish_nodes(spark, nodes, [*TABLES, *[f"predictions_{s.response}" for s in specs]], root, {"predictions_": "predictions"}, "results")
