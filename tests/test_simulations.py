"""Draws of the bootstrap, and the flags of mixed models, against numpy."""

import math

import numpy as np
import pytest

from segflow.operators import models


def table(spark, tau, seed=3, groups=40, each=12):
    draw = np.random.default_rng(seed)
    shift = draw.normal(0, tau, groups)
    rows = [(g, float(x), float(1 + 2 * x + shift[g] + draw.normal(0, 0.5))) for g in range(groups) for x in draw.uniform(0, 5, each)]
    return spark.createDataFrame(rows, "g int, x double, y double"), np.array(rows)


def test_draws_have_their_moments():
    keys = np.arange(1, 201, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    u, z = models._uniform(keys, 400, 5), models._normal(keys, 400, 3)
    assert 0 < u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.005 and abs(z.mean()) < 0.01 and abs(z.std() - 1) < 0.01
    assert abs(np.corrcoef(u[:, 0], u[:, 1])[0, 1]) < 0.25 and abs(np.corrcoef(u.ravel(), models._uniform(keys, 400, 6).ravel())[0, 1]) < 0.01
    for free in (0, 1, 2, 7, 400):
        c = models._chisquare(keys, 400, np.full(200, free))
        assert abs(c.mean() - free) < 0.02 * free + 1e-12 and abs(c.var() - 2 * free) < 0.05 * 2 * free + 1e-12


def test_products_have_the_models_moments():
    rng = np.random.default_rng(1)
    x = np.column_stack([np.ones(30), rng.uniform(0, 5, 30)])
    full = np.column_stack([x, np.zeros(30)])
    fit = {"beta": np.array([1.0, 2.0]), "tau2": 0.7, "sigma2": 0.3}
    keys = np.arange(1, 5, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    made = models.draw_products(np.stack([full.T @ full] * 4), keys, fit, 20_000).reshape(-1, 3)
    y = x @ fit["beta"] + rng.normal(0, math.sqrt(0.7), (20_000, 1)) + rng.normal(0, math.sqrt(0.3), (20_000, 30))
    wanted = np.column_stack([y @ x, (y * y).sum(1)])
    assert np.allclose(made.mean(0), wanted.mean(0), rtol=0.01) and np.allclose(np.cov(made.T), np.cov(wanted.T), rtol=0.05)


def test_shrunk_sums_equal_a_loop():
    rng = np.random.default_rng(2)
    m, last, ratios = [], rng.normal(size=(5, 3, 3)), rng.uniform(0, 2, (3, 4))
    for n in (3, 9, 1, 4, 20):
        a = np.column_stack([np.ones(n), rng.normal(size=(n, 2))])
        m.append(a.T @ a)
    m = np.array(m)
    sums, dets = models.shrunk_sums(m, last, ratios)
    for s in range(3):
        for p in range(4):
            total, log = np.zeros((3, 3)), 0.0
            for g in range(5):
                own, r = m[g].copy(), ratios[s, p]
                own[:-1, -1] = own[-1, :-1] = last[g, s, :-1]
                own[-1, -1] = last[g, s, -1]
                total += own - r / (1 + own[0, 0] * r) * np.outer(own[0], own[0])
                log += math.log1p(own[0, 0] * r)
            assert np.allclose(sums[s, p], total) and dets[s, p] == pytest.approx(log)


def test_bootstrap_does_not_depend_on_batches(spark, monkeypatch):
    df, rows = table(spark, 1.0)
    grid = [{"x": 0.0}, {"x": 2.5}]
    found = models.bootstrap_ci(df, ["x"], "y", "g", grid, nsim=60).collect()
    monkeypatch.setattr(models, "DRAW_CELLS", 60 * 24 * 3)
    again = models.bootstrap_ci(df.repartition(3), ["x"], "y", "g", grid, nsim=60).collect()
    for a, b in zip(found, again):
        assert a.fit == pytest.approx(b.fit, rel=1e-9) and a.low == pytest.approx(b.low, rel=1e-6) and a.high == pytest.approx(b.high, rel=1e-6)
        assert a.low < a.fit < a.high
    wide = 2 * 1.96 * math.sqrt(1.0 / 40 + 0.25 / 480)
    assert 0.6 < (found[1].high - found[1].low) / wide < 1.5


def brute_flags(rows, tau2, sigma2, beta):
    g, x, y = rows.T
    left = y - beta[0] - beta[1] * x
    shift = np.array([tau2 / (sigma2 + n * tau2) * left[g == k].sum() for k in np.unique(g) for n in [(g == k).sum()]])
    fitted = y - left + shift[g.astype(int)]
    u = (y - fitted) ** 2 / ((y - fitted) ** 2).mean()
    slope = np.polyfit(fitted, u, 1)[0]
    return slope**2 * ((fitted - fitted.mean()) ** 2).sum() / 2


def test_flags_of_mixed_models(spark):
    df, rows = table(spark, 1.0)
    found = models.mixed_flags(df, ["x"], "y", "g").first()
    assert (found.singular_fit, found.converged, found.messages, found.n) == (False, True, None, 480)
    fit = {r.term: r for r in models.fit_random_intercept(df, ["x"], "y", "g").collect()}
    wanted = brute_flags(rows, found.tau2, found.sigma2, [fit["(intercept)"].estimate, fit["x"].estimate])
    assert found.heteroscedasticity_chi2 == pytest.approx(wanted, rel=1e-6) and found.heteroscedasticity_p > 0.001
    g, x, y = rows.T
    centered = [(int(a), float(b), float(c)) for a, b, c in zip(g, x, y - np.array([(y - 2 * x)[g == k].mean() for k in g]))]
    none = models.mixed_flags(spark.createDataFrame(centered, "g int, x double, y double"), ["x"], "y", "g").first()
    assert none.singular_fit and none.converged and none.tau2 == 0
    twice = models.mixed_flags(df.withColumn("x2", df.x * 2), ["x", "x2"], "y", "g").first()
    assert not twice.converged and "dependent" in twice.messages
    growing = [(int(a), float(b), float(1 + 2 * b + (c - 1 - 2 * b) * b**3)) for a, b, c in zip(g, x, y)]
    assert models.mixed_flags(spark.createDataFrame(growing, "g int, x double, y double"), ["x"], "y", "g").first().heteroscedasticity_p < 1e-6


def test_flags_of_linear_models(spark):
    df, rows = table(spark, 0.0)
    found = models.linear_flags(df, ["x"], "y").first()
    g, x, y = rows.T
    slope, start = np.polyfit(x, y, 1)
    assert (found.model_class, found.singular_fit, found.converged) == ("lm", None, None)
    assert found.heteroscedasticity_chi2 == pytest.approx(brute_flags(rows, 0.0, 1.0, [start, slope]), rel=1e-6)
    flat = models.linear_flags(spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)], "x double, y double"), ["x"], "y").first()
    assert flat.n == 3
