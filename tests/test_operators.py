"""Truth tables, properties and numpy checks of the operators."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import periods as pf
from palimpsest.operators import bitemporal as bt
from palimpsest.operators import backtests as bk
from palimpsest.operators import evaluation as ev
from palimpsest.operators import models as md
from palimpsest.operators import timeseries as ts
from palimpsest.operators import vintage as vt
from palimpsest.plans.base import Tables, gappy, panel, revised
from palimpsest.sources import files


def series(spark, values, start=dt.date(2020, 1, 31)):
    rows, y, m = [], start.year, start.month
    for k, v in enumerate(values):
        end = dt.date(y + (m + k) // 12, (m + k) % 12 + 1, 1) - dt.timedelta(days=1)
        rows.append(("s", end, v))
    return spark.createDataFrame(rows, "series_id string, period_date date, value double")


def column(df, name):
    return [r[name] for r in df.orderBy("period_date").collect()]


@pytest.mark.parametrize(
    ("values", "expected"),
    [
        ([1.0, None, 3.0], [1.0, 2.0, 3.0]),
        ([1.0, None, None, 4.0], [1.0, 2.0, 3.0, 4.0]),
        ([1.0, None, None, None, 5.0], [1.0, 2.0, 3.0, 4.0, 5.0]),
        ([1.0, None, None, None, None, 6.0], [1.0, None, None, None, None, 6.0]),
        ([None, 2.0, None], [None, 2.0, None]),
        ([None, None], [None, None]),
        ([1.0, 2.0], [1.0, 2.0]),
    ],
)
def test_imputation(spark, values, expected):
    assert column(ts.impute_gaps(series(spark, values)), "filled") == expected


def test_imputation_keeps_values_and_long_runs(spark, sf_dir):
    d = ts.impute_gaps(ts.dense(gappy(Tables(spark, sf_dir))))
    assert d.where("value is not null and filled <> value").isEmpty()


@pytest.mark.parametrize(("values", "logged"), [([1.0, 2.0], True), ([0.0, 2.0], False), ([-1.0, 2.0], False)])
def test_log_needs_a_positive_series(spark, values, logged):
    out = column(ts.seasonal_diff(series(spark, values), 1), "diff")[1]
    assert out == pytest.approx(np.log(2.0) if logged else values[1] - values[0])


def test_second_difference_and_its_compatible_form(spark):
    d = series(spark, [1.0, 4.0, 9.0, 16.0])
    assert column(ts.difference(d, 2), "diff") == [None, None, 2.0, 2.0]
    assert column(ts.difference(d, 2, strict_compat=True), "diff") == [None, None, 8.0, 12.0]


def test_cutoffs(spark):
    q = spark.createDataFrame([(dt.date(2020, 12, 31),)], "target_quarter date")
    got = {r.label: r.cutoff for r in vt.cutoffs(q).collect()}
    assert got == {-2: dt.date(2020, 10, 31), -1: dt.date(2020, 11, 30), 0: dt.date(2020, 12, 31), 1: dt.date(2021, 1, 31), 2: dt.date(2021, 2, 28)}


def test_target_is_seen_after_thirty_days(spark):
    q = spark.createDataFrame([(dt.date(2020, 12, 31),)], "target_quarter date")
    y = spark.createDataFrame([(dt.date(2020, 12, 31), 1.0)], "period_date date, value double")
    seen = {r.label: r.value for r in vt.visible_target(y, vt.cutoffs(q)).collect()}
    assert seen == {0: None, 1: 1.0, 2: 1.0}


def test_vintages_never_look_ahead_and_only_grow(spark, sf_dir):
    p = panel(Tables(spark, sf_dir)).withColumn("lag", F.lit(1))
    q = spark.createDataFrame([(dt.date(1999, 12, 31),)], "target_quarter date")
    m = vt.visible(p, vt.cutoffs(q)).persist()
    assert m.where("period_date > cutoff").isEmpty()
    assert m.where("value is not null and period_date > last_day(add_months(cutoff, -1))").isEmpty()
    seen = m.where("value is not null").select("series_id", "period_date", "label")
    older = seen.withColumn("label", F.col("label") + 1).where("label <= 2")
    assert older.join(seen, ["series_id", "period_date", "label"], "left_anti").isEmpty()


def test_as_of_moves_with_time(spark):
    rows = [(1, dt.date(2020, 1, 1), dt.datetime(2020, 2, d), float(d)) for d in (1, 5, 9)]
    d = spark.createDataFrame(rows, "series_id int, period_date date, observed_at timestamp, value double")
    at = lambda x: [r.value for r in bt.as_of(d, F.lit(x).cast("timestamp")).collect()]
    assert (at("2020-01-31"), at("2020-02-06"), at("2021-01-01")) == ([], [5.0], [9.0])


def test_append_twice_adds_nothing(spark, sf_dir, tmp_path):
    d = revised(Tables(spark, sf_dir)).select("series_id", "period_date", "observed_at", "value", "event_id")
    path = str(tmp_path / "store")
    first = bt.append_idempotent(d, path, tie="event_id")
    assert first > 0
    assert bt.append_idempotent(d, path, tie="event_id") == 0
    assert spark.read.parquet(path).count() == first


def test_json_merge_prefers_new_values_unless_null(spark):
    d = spark.createDataFrame([('{"a":"1","b":"2"}', '{"b":"3","c":null}')], "o string, n string")
    import json

    assert json.loads(d.select(bt.merge_json(F.col("o"), F.col("n"))).first()[0]) == {"a": "1", "b": "3"}


def test_accuracy_rules(spark):
    d = spark.createDataFrame([("m", 0.0, 1e-8), ("m", None, 1.0), ("m", 2.0, 1.0), ("e", None, None)], "model string, actual double, predicted double")
    got = {r.model: r for r in ev.metrics(d, ["model"]).collect()}
    assert (got["m"].n_obs, got["m"].mae) == (2, pytest.approx(0.5, abs=1e-6))
    assert got["m"].mape == pytest.approx(75.0)
    assert (got["e"].n_obs, got["e"].rmse) == (0, None)


def test_frequency_detection(spark):
    ends = [dt.date(2020, 3, 31), dt.date(2020, 6, 30), dt.date(2020, 9, 30)]
    d = spark.createDataFrame([("q", e, 1.0) for e in ends] + [("short", e, 1.0) for e in ends[:2]] + [("m", dt.date(2020, k, 28), 1.0) for k in (1, 2, 3)], "series_id string, period_date date, value double")
    assert {r.series_id: r.frequency for r in ts.detect_frequency(d).collect()} == {"q": "Q", "short": "M", "m": "M"}


def test_quarter_label_round_trip(spark):
    d = spark.createDataFrame([("2020Q3",), ("2020Q5",), (None,)], "l string")
    assert [r[0] for r in d.select(pf.quarter_of_label(F.col("l"))).collect()] == [dt.date(2020, 9, 30), None, None]


def test_kpss_tells_noise_from_walks():
    rng = np.random.default_rng(1)
    noise = rng.normal(size=300)
    assert md.kpss(noise) == pytest.approx(0.1) and md.kpss(np.cumsum(noise)) < 0.05
    assert md.kpss(noise[:9]) is None and md.kpss(np.ones(50)) is None
    assert md.needed_diffs(np.cumsum(noise)) == 1


def test_elastic_net_meets_its_optimality_conditions():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(80, 6)), rng.normal(size=80)
    w = md.coordinate_descent(x, y, 0.1, 0.5, rounds=5000, tol=1e-12)
    slope = x.T @ (y - x @ w) / 80 - 0.1 * 0.5 * w
    on = w != 0
    assert np.allclose(slope[on], 0.05 * np.sign(w[on]), atol=1e-8) and (np.abs(slope[~on]) <= 0.05 + 1e-8).all()


def test_loose_minnesota_prior_is_least_squares():
    y = np.cumsum(np.random.default_rng(3).normal(size=(60, 2)), axis=0)
    assert np.allclose(md.bvar_fit(y, 1, tight=1e6, cross=1e6), md.var_fit(y, 1), atol=1e-5)
    assert np.allclose(md.bvar_fit(y, 1, tight=1e-6)[1:], np.eye(2), atol=1e-3)


def test_ar_forecast_follows_its_recursion():
    x = [1.0]
    for _ in range(40):
        x.append(0.5 * x[-1] + 2)
    assert md.ar_forecast(np.asarray(x[:8]), 1, 3) == pytest.approx(x[8:11], abs=1e-6)
    assert list(md.ar_forecast(np.asarray([3.0, 4.0]), 3, 2)) == [4.0, 4.0]


def test_backtest_folds_see_only_their_past(spark):
    rng = np.random.default_rng(4)
    days = [dt.date(2000 + k // 12, k % 12 + 1, 28) for k in range(40)]
    xs = rng.normal(size=(40, 2))
    p = spark.createDataFrame([(f"x{j}", d, float(xs[k, j])) for k, d in enumerate(days) for j in (0, 1)], "series_id string, period_date date, value double")
    y = spark.createDataFrame([(d, float(2 * xs[k, 0] - xs[k, 1])) for k, d in enumerate(days)], "period_date date, y double")
    f = ev.folds(y, 20, 5)
    assert f.where("train_end >= test_end").isEmpty() and f.count() == 4
    out = bk.backtest(p, y, f, "ridge", {"alpha": 1e-6}).collect()
    assert len(out) == 20 and max(abs(r.actual - r.predicted) for r in out) < 1e-3


def test_panel_discovery_and_reading(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.find_panel(str(tmp_path))
    spark.createDataFrame([(dt.date(2020, 1, 31), 1.0), (dt.date(2020, 2, 29), 2.0)], "period_date date, GDP double").write.parquet(str(tmp_path / "panel_M_x.parquet"))
    path = files.find_panel(str(tmp_path))
    assert path.endswith("panel_M_x.parquet") and files.meta_path(path).endswith("meta_M_x.csv")
    assert files.to_long(files.read_panel(spark, path)).count() == 2
    assert files.resolve_target(None, ["a", "GDP"]) == "GDP" and files.resolve_target("clv", ["a"], {"a": "x.CLV_I10"}) == "a"
    with pytest.raises(KeyError):
        files.resolve_target("none", ["a"])


def test_snapshot_with_transform_codes(spark, tmp_path):
    (tmp_path / "s.csv").write_text("sasdate,A,B\nTransform:,5,2\n1/1/2020,1.5,x\nbad,1,1\n2/1/2020,2.5,3\n")
    df, codes = files.read_snapshot(spark, str(tmp_path / "s.csv"))
    assert codes == {"A": 5, "B": 2}
    assert [(r.A, r.B) for r in df.orderBy("period_date").collect()] == [(1.5, None), (2.5, 3.0)]


def test_delimited_text_with_leading_lines(spark, tmp_path):
    (tmp_path / "d.txt").write_text("note\nmore\na;b\n1;2\n3;\n")
    assert [tuple(r) for r in files.read_delimited(spark, str(tmp_path / "d.txt"), ";", skip=2).collect()] == [("1", "2"), ("3", None)]


def test_selectors_find_what_matters():
    from palimpsest.operators import selectors as sl

    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 8))
    y = 3 * x[:, 2] - 2 * x[:, 5] + 0.1 * rng.normal(size=200)
    x[::17, 0] = np.nan
    assert set(sl.Penalised(alpha=0.3).fit(x, y).columns) == {2, 5}
    assert len(sl.Penalised(alpha=100.0).fit(x, y).columns) == 5 and len(sl.Penalised(alpha=0.0001, most=3).fit(x, y).columns) == 3
    assert set(sl.Informative(2).fit(x, y).columns) == {2, 5}
    f = rng.normal(size=(300, 1))
    z = f @ np.ones((1, 6)) + 0.5 * rng.normal(size=(300, 6))
    for kind in (sl.Components(1), sl.Factors(1)):
        assert abs(np.corrcoef(kind.fit(z).transform(z)[:, 0], f[:, 0])[0, 1]) > 0.95
    assert sl.Identity().fit(x).transform(x) is x


def test_cached_decisions_hold_while_series_hardly_grow(spark):
    from palimpsest.sources.sinks import audit_row, reuse_cache

    s = spark.createDataFrame([("a", 100), ("b", 100), ("c", 100), ("d", 100)], "series_id string, n long")
    cache = spark.createDataFrame([("a", 95, "log", True), ("b", 80, "log", True), ("c", 100, "log", False)], "series_id string, n long, decision string, success boolean")
    old, new = reuse_cache(s, cache)
    assert [r.series_id for r in old.collect()] == ["a"] and {r.series_id for r in new.collect()} == {"b", "c", "d"}
    assert audit_row(spark, 1, "ok", 2, 0, {"b": 1}).first().details == '{"b": 1}'
