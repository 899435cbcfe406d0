"""Factor model, Bayesian VAR, preparation, searches and sources against direct computations."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import factor_model as fm
from palimpsest.operators import metadata as me
from palimpsest.operators import models as md
from palimpsest.operators import search as se
from palimpsest.operators import vintage as vt


def simulated(steps=120, series=8, seed=7):
    rng = np.random.default_rng(seed)
    f = np.zeros(steps)
    for t in range(1, steps):
        f[t] = 0.8 * f[t - 1] + rng.normal()
    x = np.outer(f, rng.uniform(0.5, 1.5, series)) + 0.5 * rng.normal(size=(steps, series))
    return f, (x - x.mean(axis=0)) / x.std(axis=0)


@pytest.mark.parametrize("factors, order", [(1, 1), (2, 1), (1, 2)])
def test_kalman_likelihood_and_smoother_are_those_of_the_joint_normal(factors, order):
    rng = np.random.default_rng(3)
    steps, series = 6, 3
    transition = rng.normal(size=(factors, factors * order)) * 0.3
    p = fm.Parameters(rng.normal(size=(series, factors)), transition, np.eye(factors), rng.uniform(0.5, 1, series))
    move, spread = p.companion
    m = len(move)
    state = [p.start()]
    for _ in range(steps - 1):
        state.append(move @ state[-1] @ move.T + spread)
    joint = np.zeros((steps * m, steps * m))
    for t in range(steps):
        block = state[t]
        for u in range(t, steps):
            joint[u * m : (u + 1) * m, t * m : (t + 1) * m] = block
            joint[t * m : (t + 1) * m, u * m : (u + 1) * m] = block.T
            block = move @ block
    load = np.kron(np.eye(steps), np.hstack([p.loadings, np.zeros((series, m - factors))]))
    x = rng.normal(size=(steps, series))
    x[1, 0] = x[4, :2] = np.nan
    x[2] = np.nan
    on = ~np.isnan(x.ravel())
    cov = (load @ joint @ load.T + np.kron(np.eye(steps), np.diag(p.noise)))[np.ix_(on, on)]
    e = x.ravel()[on]
    want = -0.5 * (on.sum() * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1] + e @ np.linalg.solve(cov, e))
    total, filtered, smooth, variances, lagged, _ = fm.kalman(x, p)
    assert np.isclose(total, want)
    gain = joint @ load.T[:, on] @ np.linalg.inv(cov)
    after = joint - gain @ load[on] @ joint
    assert np.allclose(smooth.ravel(), gain @ e)
    for t in range(steps):
        assert np.allclose(variances[t], after[t * m : (t + 1) * m, t * m : (t + 1) * m])
        if t:
            assert np.allclose(lagged[t], after[t * m : (t + 1) * m, (t - 1) * m : t * m])
    assert np.allclose(filtered[-1], smooth[-1])


def test_expectation_maximisation_raises_the_likelihood_and_finds_the_factor():
    f, x = simulated()
    x[-2:, 3:] = np.nan
    x[10:14, 0] = np.nan
    p, path = fm.fitted(x, 1, 1, rounds=40)
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(path, path[1:]))
    assert abs(np.corrcoef(fm.kalman(x, p)[2][:, 0], f)[0, 1]) > 0.95


def test_dynamic_factor_nowcasts_from_the_panel():
    f, x = simulated(seed=9)
    y = 2 + 0.7 * f
    m = fm.DynamicFactor(1, 1).fit(x[:100], y[:100])
    assert np.corrcoef(m.predict(x[100:]), y[100:])[0, 1] > 0.9
    with pytest.raises(ValueError):
        fm.DynamicFactor().fit(np.full((20, 1), np.nan), y[:20])


def test_minnesota_posterior_of_uneven_scales_solves_the_normal_equations():
    y = np.cumsum(np.random.default_rng(3).normal(size=(60, 2)), axis=0) * [1.0, 100.0]
    b = md.bvar_fit(y, 2, 0.2, 0.5, 1.0)
    x, target = md.var_design(y, 2)
    sd = y.std(axis=0) + 1e-8
    for j in range(2):
        var, mean = [1e6], [0.0]
        for lag in (1, 2):
            for i in range(2):
                var.append((0.2 / lag) ** 2 if i == j else (0.2 * 0.5 / lag * sd[i] / sd[j]) ** 2)
                mean.append(float(lag == 1 and i == j))
        left = x.T @ x @ b[:, j] + b[:, j] / np.asarray(var)
        assert np.allclose(left, x.T @ target[:, j] + np.asarray(mean) / np.asarray(var), rtol=1e-6)


def test_evaluated_vintages_use_what_was_known(spark):
    rng = np.random.default_rng(2)
    quarters = pd.date_range("2000-03-31", periods=40, freq="QE")
    x = rng.normal(size=40)
    panel = spark.createDataFrame([("a", q.date(), float(v), 0) for q, v in zip(quarters, x)], "series_id string, period_date date, value double, lag int")
    target = spark.createDataFrame([(q.date(), float(3 * v)) for q, v in zip(quarters, x)], "period_date date, value double")
    cuts = spark.createDataFrame([(quarters[-1].date(), 0, quarters[-1].date())], "target_quarter date, label int, cutoff date")
    built = vt.build(panel, target, cuts)
    assert built.where("series_id = '__target' and split = 'test' and value is null").count() == 1
    r = md.evaluated(built, "ridge", {"alpha": 1e-6}).first()
    assert r.status == "success" and abs(r.predicted - 3 * x[-1]) < 0.05 and r.n_train == 39 - 0
    changed = target.withColumn("value", F.when(F.col("period_date") == F.lit(quarters[-1].date()), 1e6).otherwise(F.col("value")))
    assert abs(md.evaluated(vt.build(panel, changed, cuts), "ridge", {"alpha": 1e-6}).first().predicted - r.predicted) < 1e-9
    assert {x.value for x in vt.build(panel, target, cuts, "mean").where("series_id = 'a'").collect()} == set(map(float, x))
    with pytest.raises(ValueError):
        vt.build(panel, target, cuts, "other")


def test_options_and_names(tmp_path):
    from palimpsest.sources.files import first_config, with_retry

    assert se.run_suffix({"model": "dfm", "k": 3, "flag": True, "none": None, "text": "a b/c"}) == "model-dfm_k-3_flag-True_text-a-b-c"
    assert len(se.run_suffix({"x": "y" * 400})) <= 180
    assert se.signature({"b": 1, "a": 2}) == se.signature({"a": 2, "b": 1})
    assert me.time_dimension(["X", "TIME"]) == "TIME" and me.time_dimension(["X", "T"], "T") == "T" and me.guessed_dimension(["GEO", "A"], me.GEO_NAMES) == "GEO"
    with pytest.raises(ValueError):
        me.time_dimension(["X"])
    (tmp_path / "b.json").write_text('{"k": 1}')
    assert first_config([str(tmp_path / "a.json"), str(tmp_path / "b.json")]) == {"k": 1}
    with pytest.raises(FileNotFoundError):
        first_config([str(tmp_path / "a.json")])
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "read"

    assert with_retry(flaky, sleep=waits.append) == "read" and len(waits) == 2 and 1 <= waits[0] < 2 <= waits[1] < 3
    with pytest.raises(OSError):
        with_retry(lambda: (_ for _ in ()).throw(OSError()), 2, sleep=lambda s: None)


def test_manifest_and_resume(spark, tmp_path):
    se.save_manifest(spark, f"{tmp_path}/m", {"a": 1})
    assert [r.value for r in spark.read.text(f"{tmp_path}/m").collect()] == ['{"a": 1}']


def _records(page, headers=None):
    n = 3 if page <= 5 else 1 if page == 6 else 0
    return json.dumps({"items": [{"k": 10 * page + i, "who": (headers or {}).get("Authorization")} for i in range(n)]})


def test_pages_are_read_until_one_is_short(spark):
    from palimpsest.sources import paged

    for lanes in (1, 4):
        spark.dataSource.register(paged.open_source("open_pages", _records, 3, ["items"], ["k", "who"], lanes, paged.bearer("t")))
        rows = spark.read.format("open_pages").load().collect()
        assert sorted(int(r.k) for r in rows) == sorted([10 * p + i for p in range(1, 6) for i in range(3)] + [60])
        assert {r.who for r in rows} == {"Bearer t"}


def test_append_takes_null_keys_once_and_reads_only_the_batchs_dates(spark, tmp_path):
    from palimpsest.operators.bitemporal import append_idempotent

    d = spark.createDataFrame([(1, "2020-01-01", 1.0), (None, "2020-01-01", 2.0), (1, None, 3.0)], "series_id long, period_date string, value double").withColumn("period_date", F.col("period_date").cast("date"))
    key = ["series_id", "period_date"]
    assert [append_idempotent(d, f"{tmp_path}/s", key) for _ in range(2)] == [3, 0]
    later = d.where("series_id = 1").withColumn("period_date", F.lit("2021-01-01").cast("date")).limit(1)
    assert append_idempotent(later, f"{tmp_path}/s", key) == 1 and append_idempotent(d, f"{tmp_path}/s", key) == 0
