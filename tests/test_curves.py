"""Curves from aggregates against fits of all rows by numpy."""

import numpy as np
import pytest

from segflow.operators import curves
from segflow.operators.norms import basis_for, design, quantile_fit, weighted_fit

GRID = [4.0, 9.0, 15.5, 22.0, 40.0]


def rows(seed=5):
    """Groups of many, four, three and one age, a tiny one, and nulls."""
    rng = np.random.default_rng(seed)
    made = []
    for name, ages in (("many", np.arange(8, 37)), ("four", np.array([8, 12, 20, 30])), ("five", np.array([8, 9, 20, 30, 31])), ("three", np.array([10, 20, 30])), ("one", np.array([12]))):
        for _ in range(150):
            x = float(rng.choice(ages, p=np.arange(1, len(ages) + 1) / np.arange(1, len(ages) + 1).sum()))
            made.append((name, x, float(round(2 * x + 20 * np.sin(x / 4) + rng.normal(0, 6)))))
    made += [("tiny", 8.5, 3.0), ("tiny", 8.9, 5.0), ("tiny", 10.0, 1.0), ("many", None, 1.0), ("many", 9.0, None), (None, 9.0, 4.0)]
    return made


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(), "g string, age double, y double").repartition(3).cache()


def groups(least, ages):
    found = {}
    for g, x, y in rows():
        if x is not None and y is not None:
            found.setdefault(g or "", []).append((x, y))
    for g, v in found.items():
        x, y = np.array(v).T
        yield g, x, y, len(x) < least or len(np.unique(x)) < ages


def test_shapes_equal_those_of_all_rows(spark, table):
    counted = curves.counted(table, ["g"], "age", "y")
    for per_range in (2, 10**6):
        found = {r.g: r for r in curves.shapes(counted, ["g"], per_range).collect()}
        for g, x, _, _ in groups(0, 0):
            ages, w = np.unique(x, return_counts=True)
            low, high, knots = basis_for(ages, w.astype(float))
            assert (found[g].low, found[g].high, found[g].n, found[g].ages) == (low, high, len(x), len(ages))
            assert (found[g].knots is None) == (knots is None) and (knots is None or np.allclose(found[g].knots, knots))


def test_mean_curves_equal_least_squares(table):
    found = {(r.g, r.age): r for r in curves.mean_curves(table, "age", "y", GRID, 80.0, ["g"]).collect()}
    n = 0
    for g, x, y, small in groups(6, 4):
        if small:
            for m in np.unique(np.floor(x)):
                r = found[g, m]
                assert r.method == "median" and r.predicted == np.median(y[np.floor(x) == m]) and r.n == len(x) and np.isnan(r.r2)
                n += 1
            continue
        ages, w = np.unique(x, return_counts=True)
        shape = basis_for(ages, w.astype(float))
        beta = weighted_fit(design(x, shape), y, np.ones(len(x)))
        r2 = 1 - ((y - design(x, shape) @ beta) ** 2).sum() / ((y - y.mean()) ** 2).sum()
        for a in GRID:
            r = found[g, a]
            assert r.method == "spline" and r.predicted == pytest.approx(np.clip(design(np.clip([a], shape[0], shape[1]), shape) @ beta, 0, 80)[0], abs=1e-6) and r.r2 == pytest.approx(r2, abs=1e-9) and r.n == len(x)
            n += 1
    assert n == len(found)


@pytest.mark.parametrize(("per_task", "rounds"), [(10**6, 100), (30, 3)])
def test_quantile_curves_do_not_depend_on_the_task(table, per_task, rounds):
    quantiles = (0.25, 0.9)
    some = table.where("g IN ('many', 'four', 'five', 'tiny')") if per_task == 30 else table
    found = {(r.g, r.quantile, r.age): r for r in curves.quantile_curves(some, "age", "y", GRID, 80.0, quantiles, ["g"], pairs_per_task=per_task, rounds=rounds).collect()}
    names, n = {k[0] for k in found}, 0
    for g, x, y, small in groups(20, 5):
        if g not in names:
            continue
        top = np.full(len(GRID), -np.inf)
        pairs, w = np.unique(np.stack([x, y], 1), axis=0, return_counts=True)
        ages, mass = np.unique(x, return_counts=True)
        shape = basis_for(ages, mass.astype(float))
        for q in quantiles:
            if small:
                level = np.full(len(GRID), np.quantile(y, q))
            else:
                level = design(np.clip(GRID, shape[0], shape[1]), shape) @ quantile_fit(design(pairs[:, 0], shape), pairs[:, 1], w.astype(float), q, rounds)
            top = np.maximum(top, np.clip(level, 0, 80))
            for a, v in zip(GRID, top):
                r = found[g, q, a]
                assert r.predicted == pytest.approx(v, abs=1e-5) and r.method == ("empirical" if small else "spline")
                n += 1
    assert n == len(found) and len(names) >= 4


def test_preview_equals_polynomials(table):
    found = {}
    for r in curves.preview_poly(table, "age", "y", 80.0, 5, ["g"]).collect():
        found.setdefault(r.g, []).append((r.age, r.predicted))
    for g, x, y, _ in groups(0, 0):
        degree = min(3, len(np.unique(x)) - 1)
        at = np.linspace(x.min(), x.max(), 5)
        wanted = np.clip(np.polyval(np.polyfit(x - x.mean(), y, degree), at - x.mean()), 0, 80)
        assert np.allclose(sorted(found[g]), np.stack([at, wanted], 1), atol=1e-6)


def test_curves_of_all_rows_and_of_nothing(table):
    whole = curves.mean_curves(table, "age", "y", GRID, 1e3)
    assert whole.columns[0] == "group" and whole.count() == len(GRID)
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsIn" not in plan
    assert curves.mean_curves(table.limit(0), "age", "y", GRID, 1e3).count() == 0
    assert curves.quantile_curves(table.limit(0), "age", "y", GRID, 1e3).count() == 0
    assert curves.preview_poly(table.limit(0), "age", "y", 1e3).count() == 0
