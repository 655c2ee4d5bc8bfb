import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rostrum.operators import models


def clustered(X, e, groups, k):
    inv = np.linalg.inv(X.T @ X)
    scores = np.array([(X[groups == g] * e[groups == g][:, None]).sum(axis=0) for g in np.unique(groups)])
    g, n = len(scores), len(X)
    return inv @ scores.T @ scores @ inv * (g / (g - 1)) * ((n - 1) / (n - k))


def test_moments_add_up_without_losing_digits(spark):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(5_000, 3)) + [1e9, -1e9, 0]
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b b", "c"])).repartition(7)
    got = models.moments(df, ["a", "b b", "c"])
    assert got.n == 5_000
    assert np.allclose(got.m2, np.cov(x.T, bias=True) * 5_000, rtol=1e-6, atol=1e-3)
    assert models.moments(df.limit(0), ["a", "c"]).n == 0
    parts = [models.Moments.of(x[s]) for s in (slice(0, 1), slice(1, 1), slice(1, 900), slice(900, 5_000))]
    assert np.allclose((parts[0] + parts[1] + parts[2] + parts[3]).m2, models.Moments.of(x).m2)


def test_slopes_and_errors_with_large_means(spark):
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=2_000)
    y = 3 * x + rnd.normal(size=2_000)
    X = np.column_stack([np.ones(2_000), x])
    beta, rss = np.linalg.lstsq(X, y, rcond=None)[:2]
    se = math.sqrt(rss[0] / 1_998 * np.linalg.inv(X.T @ X)[1, 1])
    f = models.ols(spark.createDataFrame(pd.DataFrame({"x": x + 1e9, "y": y + 1e9})), "y", ["x"])
    assert f.coefficient("x") == pytest.approx(beta[1], rel=1e-5) and math.sqrt(f.vcov[1, 1]) == pytest.approx(se, rel=1e-5)
    assert f.r2 == pytest.approx(1 - rss[0] / ((y - y.mean()) ** 2).sum(), rel=1e-5)


def test_four_hundred_dummies_in_one_pass(spark):
    rnd = np.random.default_rng(3)
    n, k = 8_000, 401
    f, x = rnd.integers(0, k, n), rnd.normal(size=n)
    y = x + f * 0.01 + rnd.normal(size=n)
    X = np.column_stack([np.ones(n), x, (f[:, None] == np.arange(1, k)).astype(float)])
    beta, rss = np.linalg.lstsq(X, y, rcond=None)[:2]
    se = np.sqrt(rss[0] / (n - X.shape[1]) * np.diag(np.linalg.inv(X.T @ X)))
    fit = models.ols(spark.createDataFrame(pd.DataFrame({"y": y, "x": x, "f": f})), "y", ["x"], ["f"])
    assert fit.terms == ["(Intercept)", "x", *(f"f{i}" for i in range(1, k))]
    assert np.allclose(fit.beta, beta, atol=1e-8) and np.allclose(np.sqrt(np.diag(fit.vcov)), se, rtol=1e-8)
    with pytest.raises(ValueError):
        models.ols(spark.range(500).select(F.col("id").alias("f"), F.rand(1).alias("y")), "y", [], ["f"])


def unbalanced(rnd, n=900, members=40, years=9):
    a, t = rnd.integers(0, members, n), rnd.integers(0, years, n)
    keep = (a + t) % 3 > 0  # some pairs of levels never meet
    a, t = a[keep], t[keep]
    x = rnd.normal(size=len(a)) + 0.1 * a - 0.2 * t
    return a, t, x, 2 * x + 0.5 * a + t + rnd.normal(size=len(a))


def test_two_effects_with_clustered_errors(spark):
    a, t, x, y = unbalanced(np.random.default_rng(4))
    X = np.column_stack([x, np.eye(40)[a], np.eye(9)[t][:, 1:]])
    beta = np.linalg.lstsq(X, y, rcond=None)[0]
    df = spark.createDataFrame(pd.DataFrame({"y": y, "x": x, "a": a, "t": t, "far": a // 5})).repartition(3)
    for order in (["a", "t"], ["t", "a"]):
        f = models.ols_absorbed(df, "y", ["x"], order, cluster="a")
        want = clustered(X, y - X @ beta, a, 1 + 8)
        assert f.coefficient("x") == pytest.approx(beta[0], rel=1e-8) and math.sqrt(f.vcov[0, 0]) == pytest.approx(math.sqrt(want[0, 0]), rel=1e-6)
        assert f.df == 39
    f = models.ols_absorbed(df, "y", ["x"], ["a", "t"], cluster="far")
    assert f.vcov[0, 0] == pytest.approx(clustered(X, y - X @ beta, a // 5, X.shape[1])[0, 0], rel=1e-6)


def test_effects_of_levels_that_form_islands(spark):
    rnd = np.random.default_rng(5)
    a, t, x, y = unbalanced(rnd, 600, 20, 6)
    a, t = np.concatenate([a, a + 20]), np.concatenate([t, t + 6])  # two groups that share no level
    x, y = np.concatenate([x, x + rnd.normal(size=len(x))]), np.concatenate([y, y + 5])
    X = np.column_stack([x, np.eye(40)[a], np.eye(12)[t]])
    beta = np.linalg.lstsq(X, y, rcond=None)[0]
    f = models.ols_absorbed(spark.createDataFrame(pd.DataFrame({"y": y, "x": x, "a": a, "t": t})), "y", ["x"], ["a", "t"])
    assert f.coefficient("x") == pytest.approx(beta[0], rel=1e-7)


def test_rows_without_a_value_are_left_out(spark):
    df = spark.createDataFrame([(1.0, 1.0, "a", 1), (2.0, None, "a", 1), (4.0, 3.0, "b", 1), (5.0, 3.5, "b", 2), (6.0, 4.0, None, 2), (7.0, 9.0, "a", 2)], "y double, x double, f string, g int")
    assert models.ols(df, "y", ["x"], ["f"]).n == 4
    assert models.ols_absorbed(df, "y", ["x"], ["f", "g"]).n == 4
