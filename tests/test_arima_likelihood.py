import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import make_fact
from shelfcast.operators import arima_likelihood as A
from shelfcast.operators import features


def covariance(n, ar, ma):
    """Of a stationary ARMA(1,1) with shocks of variance 1, from its autocovariances."""
    g0 = (1 + 2 * ar * ma + ma**2) / (1 - ar**2)
    g1 = ar * g0 + ma
    lag = np.abs(np.subtract.outer(np.arange(n), np.arange(n)))
    return np.where(lag == 0, g0, g1 * ar ** np.maximum(lag - 1, 0))


def made(ar, ma, n, seed, scale=1.0):
    e = np.random.default_rng(seed).normal(0, scale, n + 200)
    w = np.zeros(n + 200)
    for t in range(1, n + 200):
        w[t] = ar * w[t - 1] + e[t] + ma * e[t - 1]
    return w[200:]


@pytest.mark.parametrize("ar,ma", [(0.0, 0.0), (0.5, 0.0), (0.0, -0.7), (0.8, 0.4), (-0.6, 0.9)])
def test_recursion_is_the_exact_likelihood(ar, ma):
    w = np.zeros((2, 30))
    w[0], w[1, :12] = made(0.4, 0.2, 30, 1), made(-0.3, 0.5, 12, 2)
    n = np.array([30, 12])
    got, variance = A.log_likelihood(w, n, np.full((2, 1), ar), np.full((2, 1), ma))
    squares, logs, guess, spread = A.recursion(w, n, np.full((2, 1), ar), np.full((2, 1), ma))
    for k in range(2):
        x, c = w[k, :n[k]], covariance(n[k] + 1, ar, ma)
        inner = c[:-1, :-1]
        s2 = x @ np.linalg.solve(inner, x) / n[k]
        want = -0.5 * (n[k] * np.log(2 * np.pi * s2) + np.linalg.slogdet(inner)[1] + n[k])
        assert got[k, 0] == pytest.approx(want) and variance[k, 0] == pytest.approx(s2)
        assert guess[k, 0] == pytest.approx(c[-1, :-1] @ np.linalg.solve(inner, x), abs=1e-9)
        assert spread[k, 0] == pytest.approx(c[-1, -1] - c[-1, :-1] @ np.linalg.solve(inner, c[:-1, -1]))


def test_fit_finds_the_greatest_likelihood():
    planted = [(0.7, 0.2), (-0.5, 0.3), (0.2, -0.6), (0.0, 0.0), (0.85, -0.3)]
    w = np.stack([made(*p, 400, i, 10.0 ** i) for i, p in enumerate(planted)])
    n = np.full(len(w), 400)
    ar, ma = A.fit(w, n)
    best = A.log_likelihood(w, n, ar[:, None], ma[:, None])[0][:, 0]
    grid = np.stack(np.meshgrid(np.linspace(-0.98, 0.98, 50), np.linspace(-0.98, 0.98, 50)), -1).reshape(-1, 2)
    others = A.log_likelihood(w, n, np.tile(grid[:, 0], (len(w), 1)), np.tile(grid[:, 1], (len(w), 1)))[0]
    assert (best >= others.max(axis=1) - 1e-6).all()
    for (a, m), fa, fm in zip(planted, ar, ma, strict=True):
        if a != -m:  # white noise fixes only the sum
            spread = abs((1 + a * m) / (a + m)) / 20  # large-sample standard errors, but for the roots
            assert abs(fa - a) < 3 * spread * np.sqrt(1 - a**2) and abs(fm - m) < 3 * spread * np.sqrt(1 - m**2)
    short = np.zeros((2, 9))
    short[0] = made(0.3, 0.3, 9, 5)
    ar, ma = A.fit(short, np.array([9, 9]))
    assert ar[1] == ma[1] == 0 and np.isfinite([ar[0], ma[0]]).all()


def test_standard_errors_match_simulated_paths():
    ar, ma, n, h = 0.6, 0.3, 40, 6
    y = np.concatenate([[0.0], np.cumsum(made(ar, ma, n, 3))])
    w = np.diff(y)[None]
    _, _, guess, spread = (v[:, 0] for v in A.recursion(w, np.array([n]), np.array([[ar]]), np.array([[ma]])))
    (level, error), = A.forecast([y], np.array([h]), np.array([ar]), np.array([ma]), np.array([1.0]), guess, spread)
    c = covariance(n + h, ar, ma)
    mean = c[n:, :n] @ np.linalg.solve(c[:n, :n], w[0])
    left = c[n:, n:] - c[n:, :n] @ np.linalg.solve(c[:n, :n], c[:n, n:])
    add = np.tril(np.ones((h, h)))
    np.testing.assert_allclose(level, y[-1] + add @ mean)
    np.testing.assert_allclose(error, np.sqrt(np.diag(add @ left @ add.T)))


def test_series_in_spark(spark):
    flat, wave = [(7.0, 0, 0.0)] * 120, np.cumsum(made(0.5, 0.1, 120, 9)) + 100
    fact = make_fact(spark, {(1, 1): flat, (1, 2): [(float(v), 0, 0.0) for v in wave], (1, 3): flat[:75]})
    parts = features.label_split(fact, "2011-07-01", "2011-07-01").where("Dept <> 3 or Date >= '2011-06-01'")
    fits = {r.Dept: r for r in A.arima_fits(parts).collect()}
    assert fits[3].Status == "too short" and fits[3].AR is None and set(fits[3].Predicted) <= {None}
    assert fits[1].Log_Likelihood is None and fits[1].Variance == 0 and set(fits[1].Predicted) == {7.0} and set(fits[1].Std_Error) == {0.0}
    assert fits[2].Log_Likelihood > A.arima_fits(parts.where("Dept = 2"), at=(0.0, 0.0)).first().Log_Likelihood
    assert np.all(np.diff(fits[2].Std_Error) > 0)
    weeks = A.likelihood_forecast(A.arima_fits(parts))
    assert weeks.count() == parts.where("split = 'test'").count()
    assert weeks.where("Dept = 3 and Predicted is null").count() == len(fits[3].Predicted)
    assert A.arima_fits(parts.limit(0)).count() == 0
    with pytest.raises(ValueError, match="between"):
        A.arima_fits(parts, at=(1.0, 0.0))
