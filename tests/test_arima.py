"""Seasonal ARIMA against a dense Gaussian, a simulated seasonal series, and every status."""

import numpy as np
import pandas as pd
import pytest

from palimpsest.operators import arima as ar
from palimpsest.operators import models as md


def covariance(phi, theta, n, terms=4000):
    """Of n values of the ARMA, by its moving-average form."""
    psi = np.zeros(terms)
    psi[0] = 1.0
    for k in range(1, terms):
        psi[k] = (theta[k - 1] if k <= len(theta) else 0.0) + sum(phi[j] * psi[k - 1 - j] for j in range(min(k, len(phi))))
    gamma = [psi[: terms - k] @ psi[k:] for k in range(n)]
    return np.asarray([[gamma[abs(i - j)] for j in range(n)] for i in range(n)])


@pytest.mark.parametrize("own, seasonal, mown, mseasonal, season", [([0.6], [], [], [], 1), ([], [], [0.5, -0.3], [], 1), ([0.5, 0.2], [], [0.4], [], 1), ([0.4], [0.5], [0.3], [-0.4], 4)])
def test_the_likelihood_is_that_of_the_dense_normal(own, seasonal, mown, mseasonal, season):
    phi = ar.polynomial(np.asarray(own), np.asarray(seasonal), season, -1.0)
    theta = ar.polynomial(np.asarray(mown), np.asarray(mseasonal), season, 1.0)
    x = np.random.default_rng(1).normal(size=40)
    x[[7, 8, 30]] = np.nan
    on = ~np.isnan(x)
    cov = 1.7 * covariance(phi, theta, 40)[np.ix_(on, on)]
    want = -0.5 * (on.sum() * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1] + x[on] @ np.linalg.solve(cov, x[on]))
    assert np.isclose(ar.Arma(phi, theta).likelihood(x, 1.7)[0], want)
    assert ar.Arma(phi, theta).likelihood(x)[0] >= want


def test_polynomials_multiply():
    assert np.allclose(ar.polynomial(np.asarray([0.5]), np.asarray([0.3]), 4, -1.0), [0.5, 0, 0, 0.3, -0.15])
    assert np.allclose(ar.polynomial(np.asarray([0.5]), np.asarray([0.3]), 4, 1.0), [0.5, 0, 0, 0.3, 0.15])
    for seed in range(5):
        a = ar.stationary(np.random.default_rng(seed).uniform(-0.95, 0.95, 3))
        assert np.abs(np.roots(np.concatenate(([1.0], -a)))).max() < 1


def test_parameters_are_found():
    r = np.random.default_rng(4)
    e = r.normal(size=1200)
    x = np.zeros(1200)
    for t in range(1, 1200):
        x[t] = 0.7 * x[t - 1] + e[t] + 0.4 * e[t - 1]
    f = ar.search(x[200:], 1, True, (2, 2, 0, 0))
    assert f.order[0] >= 1 and f.order[1] >= 1
    got = ar.fit(x[200:], (1, 1, 0, 0), 1, True)
    assert abs(got.model.move[0, 0] - 0.7) < 0.08 and abs(got.model.shock[0, 1] - 0.4) < 0.08


def test_a_seasonal_series_beats_the_autoregression():
    r = np.random.default_rng(2)
    months = np.arange(132)
    x = 10 + 3 * np.sin(months / 12 * 2 * np.pi) + 2 * (months % 12 == 11) + 0.02 * months + 0.3 * r.normal(size=132)
    out, status = ar.forecast(x[:120], 12, season=12)
    plain, _ = md.auto_ar(x[:120], 12)
    assert status == "ok" and np.abs(out - x[120:]).mean() < 0.5 * np.abs(plain - x[120:]).mean()
    full, status = ar.forecast(x[:120], 12, season=12, fast=False)
    assert status == "ok" and np.abs(full - x[120:]).mean() < 0.7


def test_trends_statuses_and_gaps():
    line = np.arange(60.0)
    out, status = ar.forecast(line + 0.01 * np.random.default_rng(1).normal(size=60), 3)
    assert status == "ok" and np.allclose(out, [60, 61, 62], atol=0.5)
    assert ar.forecast(line, 0)[1] == "no_steps" and ar.forecast(np.full(5, np.nan), 2)[1] == "empty_series"
    out, status = ar.forecast(line[:10], 2)
    assert status == "too_short_locf" and list(out) == [9, 9]
    gaps = np.sin(np.arange(80) / 3)
    gaps[[0, 1, 20, 21, 50]] = np.nan
    assert ar.forecast(gaps, 4)[1] == "ok" and ar.forecast(np.ones(50), 2)[1] in ("ok", "failed_locf")


def test_every_series_is_carried_to_the_end(spark):
    r = np.random.default_rng(3)
    dates = pd.date_range("2000-01-31", periods=60, freq="ME")
    rows = [("long", d.date(), float(v)) for d, v in zip(dates, r.normal(size=60))] + [("short", d.date(), float(k)) for k, d in enumerate(dates[:8])]
    out = ar.ragged_forecasts(spark.createDataFrame(rows, "series_id string, period_date date, value double"), "2005-03-31").toPandas()
    assert out.groupby("series_id").size().to_dict() == {"long": 3, "short": 55}
    assert set(out[out["series_id"] == "short"]["status"]) == {"too_short_locf"} and str(out["period_date"].max()) == "2005-03-31"


def test_dickey_fuller_matches_its_critical_values_and_tells_walks_from_noise():
    tail = lambda stat: 0.5 * __import__("math").erfc(-sum(c * stat**k for k, c in enumerate(md.TAU_SMALL)) / 2**0.5)
    for stat, p in ((-3.43035, 0.01), (-2.86154, 0.05), (-2.56677, 0.10)):  # published asymptotic critical values
        assert abs(tail(stat) - p) < 0.002
    r = np.random.default_rng(5)
    noise, walk = [md.adf(r.normal(size=200))[1] for _ in range(40)], [md.adf(np.cumsum(r.normal(size=200)))[1] for _ in range(200)]
    assert max(noise) < 0.01 and 0.01 <= np.mean(np.asarray(walk) < 0.05) <= 0.12
    x = np.cumsum(r.normal(size=120))
    stat, p, lags = md.adf(x)
    d, first = np.diff(x), lags
    z = np.column_stack([x[first:-1], np.ones(len(d) - first), *(d[first - k : len(d) - k] for k in range(1, lags + 1))])
    cov = np.linalg.inv(z.T @ z)
    b = cov @ z.T @ d[first:]
    e = d[first:] - z @ b
    assert np.isclose(stat, b[0] / np.sqrt(e @ e / (len(e) - z.shape[1]) * cov[0, 0]))
    assert md.adf(x[:10]) is None and md.adf(np.ones(40)) is None


def test_tails_are_forecast_once_for_each_end(spark):
    from palimpsest.operators import vintage as vt

    r = np.random.default_rng(6)
    months = pd.date_range("2000-01-31", periods=60, freq="ME")
    x = 5 + np.cumsum(r.normal(size=60))
    panel = spark.createDataFrame([("a", d.date(), float(v), 2) for d, v in zip(months, x)], "series_id string, period_date date, value double, lag int")
    cuts = spark.createDataFrame([(months[k].date(), lab, months[k].date()) for k in (47, 59) for lab in (0, 1)], "target_quarter date, label int, cutoff date")
    target = spark.createDataFrame([(d.date(), 1.0) for d in months[2::3]], "period_date date, value double")
    d = vt.build(panel, target, cuts, "arima").where("series_id = 'a'").toPandas()
    assert d["value"].notna().all() and len(d) == 2 * (48 + 60)
    own = d[(d["target_quarter"] == months[47].date()) & (d["label"] == 0)].sort_values("period_date")["value"].to_numpy()
    assert np.allclose(own[:46], x[:46]) and np.allclose(own[46:], ar.forecast(x[:46], 2)[0])
