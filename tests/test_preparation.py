"""Preparation against hand-made series: calendar differences across gaps, every reason, decisions from an earlier run."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import models as md
from palimpsest.operators import preparation as pr

MONTHS = pd.date_range("2000-01-31", periods=200, freq="ME")
SCHEMA = "series_id string, period_date date, value double"


def frame(spark, made):
    return spark.createDataFrame([(k, d.date(), float(v)) for k, x in made.items() for d, v in zip(MONTHS, x) if not math.isnan(v)], SCHEMA)


def test_differences_go_along_the_calendar(spark):
    x = np.arange(1.0, 201.0) - 300  # a line of slope 1, not positive
    for k in (7, 30, 31, 55, 56, 57, *range(100, 106)):
        x[k] = np.nan
    dense = pr.regular(frame(spark, {"line": x}))
    look = pr.first_look(dense, 36, 10.0).first()
    assert (look.initial_non_nan, look.gaps_avg_1, look.gaps_linear_23, look.dropped_reason) == (188, 1, 5, None)
    for seasonal, step in ((True, 12.0), (False, 1.0)):
        decided = spark.createDataFrame([("line", seasonal)], "series_id string, is_seasonal boolean")
        z = [r.z for r in pr.base_transformed(dense, decided).orderBy("period_date").collect()]
        assert len(z) == 200 and {round(v, 9) for v in z if v is not None} == {step}
        lag = int(step)
        filled = [v if not (100 <= k < 106) else None for k, v in enumerate(range(200))]
        assert [v is None for v in z] == [k < lag or filled[k] is None or filled[k - lag] is None for k in range(200)]


@pytest.fixture(scope="module")
def made():
    r = np.random.default_rng(1)
    season = np.tile(np.sin(np.arange(12) / 12 * 2 * np.pi), 17)[:200]
    return {
        "noise": np.exp(np.cumsum(r.normal(size=200)) / 20 + 3), "seasonal": np.exp(0.3 * season + r.normal(size=200) / 50 + 3), "flat": np.ones(200),
        "short": np.where(np.arange(200) < 60, np.arange(200.0), np.nan), "few": np.where(np.arange(200) % 30 == 0, 5.0 + np.arange(200), np.nan), "walk": np.cumsum(np.cumsum(np.cumsum(r.normal(size=200)))),
    }


def test_every_reason_and_the_numbers_of_a_kept_series(spark, made):
    report, values = pr.prepared(frame(spark, made), least=36, least_years=10.0)
    got = {r.series_id: r for r in report.collect()}
    assert set(got) == set(made) and report.columns == pr.REPORT
    assert got["short"].dropped_reason == "too_short_span" and got["few"].dropped_reason == "too_few_obs_initial" and got["flat"].dropped_reason == "almost_constant"
    assert got["seasonal"].is_seasonal and got["seasonal"].transform_applied == "yoy_diff_12" and got["seasonal"].detect_reason == "acf_lag_12_stat"
    assert got["noise"].transform_applied == "log_diff_1" and got["noise"].status == "success"
    z = np.diff(np.log(made["noise"]))
    assert math.isclose(got["noise"].d0_kpss_p, md.kpss(z)) and got["noise"].diffs_used == 0
    want = np.clip(z, *np.quantile(z, [0.01, 0.99]))
    out = [(r.period_date, r.value) for r in values.where("series_id = 'noise'").orderBy("period_date").collect()]
    assert [d for d, _ in out] == [d.date() for d in MONTHS[1:]] and np.allclose([v for _, v in out], want)
    assert {r.series_id for r in values.select("series_id").distinct().collect()} == {k for k, r in got.items() if r.dropped_reason is None}


def test_mixed_mode_keeps_nonstationary_series_and_does_not_clip(spark, made):
    walk = {k: made[k] for k in ("walk", "noise")}
    strict = {r.series_id: r for r in pr.prepared(frame(spark, walk), most_diffs=0, least=36, least_years=10.0)[0].collect()}
    report, values = pr.prepared(frame(spark, walk), mixed=True, most_diffs=0, least=36, least_years=10.0)
    mixed = {r.series_id: r for r in report.collect()}
    assert strict["walk"].dropped_reason == "kpss_nonstationary_after_diffs" and mixed["walk"].dropped_reason is None and mixed["walk"].status == "nonstationary"
    assert np.isclose(max(abs(r.value) for r in values.where("series_id = 'noise'").collect()), np.abs(np.diff(np.log(made["noise"]))).max())
    two = {r.series_id: r.diffs_used for r in pr.prepared(frame(spark, walk), least=36, least_years=10.0)[0].collect()}
    assert two["walk"] > 0 == two["noise"]


def test_metadata_decides_before_the_autocorrelation(spark, made):
    meta = spark.createDataFrame([("seasonal", "x, seasonally adjusted"), ("noise", "x, not seasonally adjusted")], "series_id string, text string")
    d = {r.series_id: r for r in pr.seasonality(pr.regular(frame(spark, {k: made[k] for k in ("seasonal", "noise")})), meta=meta).collect()}
    assert (d["seasonal"].is_seasonal, d["seasonal"].is_sa, d["seasonal"].detect_reason) == (False, True, "sa_metadata")
    assert (d["noise"].is_seasonal, d["noise"].is_sa, d["noise"].detect_reason) == (True, False, "nsa_metadata")
    only = pr.seasonality(pr.regular(frame(spark, {"seasonal": made["seasonal"]})), mode="metadata_only").first()
    assert not only.is_seasonal and only.detect_reason == "no_strong_evidence"


def test_decisions_hold_while_a_series_hardly_grows(spark, made):
    cache = spark.createDataFrame([("noise", 190, "yoy_diff_12", True, False, 1), ("seasonal", 100, "log_diff_1", False, True, 2)], "series_id string, obs_count long, transform_applied string, is_seasonal boolean, is_sa boolean, diffs_used int")
    d = {r.series_id: r for r in pr.prepared(frame(spark, {k: made[k] for k in ("seasonal", "noise")}), least=36, least_years=10.0, cache=cache)[0].collect()}
    assert (d["noise"].transform_applied, d["noise"].diffs_used, d["noise"].detect_reason, d["noise"].d0_kpss_p) == ("yoy_diff_12", 1, "loaded_from_cache", None)
    assert d["seasonal"].transform_applied == "yoy_diff_12" and d["seasonal"].detect_reason == "acf_lag_12_stat"


def test_ragged_edges_are_carried_on_and_empty_panels_are_empty(spark, made):
    x = {"noise": made["noise"].copy()}
    x["noise"][150:156] = np.nan
    report, values = pr.prepared(frame(spark, x), least=36, least_years=10.0, ragged_limit=2)
    dates = {r.period_date for r in values.collect()}
    assert MONTHS[151].date() in dates and MONTHS[152].date() not in dates and MONTHS[156].date() not in dates
    report, values = pr.prepared(spark.createDataFrame([], SCHEMA))
    assert report.count() == 0 and values.count() == 0
    d = spark.createDataFrame([("q", dt.date(2000 + k // 4, 3 * (k % 4) + 3, 28), float(k % 4 + k / 50)) for k in range(80)], SCHEMA)
    r = pr.prepared(d, to="quarter", least=36, least_years=10.0)[0].first()
    assert r.transform_applied == "yoy_diff_4" and r.is_seasonal


def windows_and_joins(df):
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return plan.count("Window ["), plan.count("SortMergeJoin")


def test_later_stages_read_stored_ones_whatever_the_panels_size_looks_like(spark, sf_dir):
    from palimpsest.plans import registry

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")  # as small tables of a large input seem to the planner
    try:
        rng = np.random.default_rng(4)
        d = pr.search_prepared(frame(spark, {"long": np.cumsum(rng.normal(size=180)), "short": rng.normal(size=20)}), "diff", 36, 5.0)
        assert windows_and_joins(d) <= (0, 1)
        assert {r.series_id: r["count"] for r in d.groupBy("series_id").count().collect()} == {"long": 179}
        w, joins = windows_and_joins(registry.queries()["preparation_stages"](spark, sf_dir))
        assert w <= 8 and joins <= 12
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
