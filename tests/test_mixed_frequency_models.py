"""Mixed-frequency factors against the joint normal distribution, and what back-tests do with months without a target."""

import numpy as np
import pandas as pd
import pytest

from palimpsest.operators import mixed_factor as mf
from palimpsest.operators import models as md


def small(order=2, factors=1, seed=1):
    r = np.random.default_rng(seed)
    quarterly = np.asarray([False, True, False])
    return mf.MixedParameters(r.normal(size=(3, factors)), r.normal(size=(factors, factors * order)) * 0.2, np.eye(factors) * 0.8, np.asarray([0.5, -0.3, 0.0]), np.asarray([0.4, 0.7, 1.1]), quarterly)


@pytest.mark.parametrize("order, factors", [(1, 1), (2, 1), (1, 2), (6, 1)])
def test_filter_and_smoother_are_those_of_the_joint_normal(order, factors):
    p = small(order, factors)
    move, shocks, see = p.system()
    m, steps = p.size, 9
    first = p.start()
    assert np.allclose(move @ first @ move.T + shocks, first)
    joint = np.zeros((steps * m, steps * m))
    for t in range(steps):
        block = first
        for u in range(t, steps):
            joint[u * m : (u + 1) * m, t * m : (t + 1) * m] = block
            joint[t * m : (t + 1) * m, u * m : (u + 1) * m] = block.T
            block = move @ block
    x = np.random.default_rng(2).normal(size=(steps, 3))
    x[[0, 1, 3, 4, 6, 7], 1] = np.nan
    x[4] = np.nan
    x[8, 0] = np.nan
    on = ~np.isnan(x.ravel())
    load = np.kron(np.eye(steps), see)[on]
    cov = load @ joint @ load.T + mf.NOISE * np.eye(on.sum())
    e = x.ravel()[on]
    total, filtered, smooth, variances, lagged = mf.smoothed(x, p)
    assert np.isclose(total, -0.5 * (on.sum() * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1] + e @ np.linalg.solve(cov, e)))
    gain = joint @ load.T @ np.linalg.inv(cov)
    after = joint - gain @ load @ joint
    assert np.allclose(smooth.ravel(), gain @ e) and np.allclose(filtered[-1], smooth[-1])
    for t in range(steps):
        assert np.allclose(variances[t], after[t * m : (t + 1) * m, t * m : (t + 1) * m])
        if t:
            assert np.allclose(lagged[t], after[t * m : (t + 1) * m, (t - 1) * m : t * m])


def simulated(months=180, series=6, seed=3):
    r = np.random.default_rng(seed)
    f, e = np.zeros(months), np.zeros((months, series))
    for t in range(1, months):
        f[t] = 0.7 * f[t - 1] + r.normal()
        e[t] = 0.4 * e[t - 1] + 0.5 * r.normal(size=series)
    x = np.outer(f, r.uniform(0.6, 1.4, series)) + e
    y = np.full(months, np.nan)
    for t in range(5, months, 3):
        y[t] = 2 + 0.5 * (mf.GROWTH @ f[t - 4 : t + 1][::-1]) + 0.1 * r.normal()
    return f, x, y


def test_expectation_maximisation_finds_the_monthly_factor():
    f, x, y = simulated()
    both = np.column_stack([x, y])
    both = (both - np.nanmean(both, axis=0)) / np.nanstd(both, axis=0)
    both[40:45, 2] = np.nan
    p, path = mf.fitted(both, np.asarray([False] * 6 + [True]), 1, 1, rounds=30)
    assert all(b >= a - 1e-3 * abs(a) for a, b in zip(path, path[1:])) and path[-1] > path[0]
    assert abs(np.corrcoef(mf.smoothed(both, p)[2][:, 0], f)[0, 1]) > 0.95


def test_nowcasts_use_every_month_of_the_quarter():
    f, x, y = simulated()
    m = mf.MixedFactor(1, 1, 30).fit(x[:150], y[:150])
    at = np.arange(150, 180)
    out = m.predict(x[150:])
    target = at[~np.isnan(y[150:])] - 150
    assert np.corrcoef(out[target], y[150:][target])[0, 1] > 0.9
    for month in (0, 1, 2):  # of the first test quarter
        changed = x[150:].copy()
        changed[target[0] - month] += 3
        assert abs(m.predict(changed)[target[0]] - out[target[0]]) > 1e-3
    with pytest.raises(ValueError):
        mf.MixedFactor().fit(x[:20], np.full(20, np.nan))
