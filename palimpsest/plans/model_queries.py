"""Model queries: rows only, for SQL cannot express them; tests hold them against direct numpy computations."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import backtests as bt
from palimpsest.operators import evaluation as ev
from palimpsest.operators import models as md
from palimpsest.operators import timeseries as ts
from palimpsest.plans.base import Tables, gappy, panel, query, target


def _growth(t: Tables):
    return ts.seasonal_diff(panel(t), 12, "g").select("series_id", "period_date", F.col("g").alias("value")).where("value is not null")


@query("kpss_pvalues")
def kpss_pvalues(spark, sf):
    return md.kpss_by_series(gappy(Tables(spark, sf)))


@query("bvar_forecast")
def bvar_forecast(spark, sf):
    return md.bvar_by_group(panel(Tables(spark, sf)).withColumn("status", F.substring("series_id", 2, 1)), "status")


@query("var_forecast")
def var_forecast(spark, sf):
    return md.bvar_by_group(panel(Tables(spark, sf)).withColumn("status", F.substring("series_id", 2, 1)), "status", bayes=False)


@query("ar_bridge")
def ar_bridge(spark, sf):
    t = Tables(spark, sf)
    return md.bridge(_growth(t), target(t))


@query("ragged_ar_fill")
def ragged_ar_fill(spark, sf):
    return md.ragged_fill(gappy(Tables(spark, sf)), "2001-12-31")


def _backtest(spark, sf, model, params):
    t = Tables(spark, sf)
    y = target(t).where("y is not null")
    return bt.backtest(_growth(t), y, ev.folds(y, 10, 1), model, params)


@query("elastic_net_vintages")
def elastic_net_vintages(spark, sf):
    return _backtest(spark, sf, "elastic_net", {})


@query("ridge_backtest")
def ridge_backtest(spark, sf):
    return _backtest(spark, sf, "ridge", {"alpha": 1.0})


@query("pca_regression")
def pca_regression(spark, sf):
    return _backtest(spark, sf, "pca_regression", {"k": 2})


@query("adf_pvalues")
def adf_pvalues(spark, sf):
    return md.adf_by_series(gappy(Tables(spark, sf)))


@query("arima_fill")
def arima_fill(spark, sf):
    """Every series carried to the last month by a seasonal ARIMA of its own."""
    from palimpsest.operators.arima import ragged_forecasts

    return ragged_forecasts(gappy(Tables(spark, sf)), "2001-12-31", season=12)


@query("boosted_backtest")
def boosted_backtest(spark, sf):
    """Boosted trees on each quarter's mean growth."""
    return _backtest(spark, sf, "boosted_trees", {"trees": 40, "depth": 2})


@query("mixed_factor_nowcast")
def mixed_factor_nowcast(spark, sf):
    """Quarterly growth from monthly factors; every month of a quarter counts."""
    return _backtest(spark, sf, "mixed_factor", {"factors": 1, "order": 1, "rounds": 15})


@query("selection_in_folds")
def selection_in_folds(spark, sf):
    """Columns chosen anew from each fold's training rows, then a ridge regression."""
    t = Tables(spark, sf)
    y = target(t).where("y is not null")
    return bt.backtest(_growth(t), y, ev.folds(y, 10, 1), "ridge", {"alpha": 1.0}, (("varying", {}), ("correlated", {"k": 4}), ("components", {"k": 2})))


def _space() -> dict:
    return {"model": ["ridge", "pca_regression"], "alpha": (0.01, 100.0, "log"), "k": (1, 4, "int")}


def _config(choice: dict) -> dict:
    params = {"alpha": choice["alpha"]} if choice["model"] == "ridge" else {"k": choice["k"]}
    return {"model": choice["model"], "params": params, "selectors": [["correlated", {"k": 5}]]}


@query("staged_search")
def staged_search(spark, sf):
    """A grid on the last three folds, and its best four configurations on all folds."""
    t = Tables(spark, sf)
    y = target(t).where("y is not null")
    grid = [{"model": "ridge", "params": {"alpha": a}, "selectors": [["correlated", {"k": k}]]} for a in (0.1, 1.0, 10.0) for k in (2, 4)]
    grid += [{"model": "pca_regression", "params": {"k": k}, "window": w} for k in (1, 2) for w in (8, None)]
    return bt.staged_search(_growth(t), y, ev.folds(y, 10, 1), bt.config_rows(spark, grid), top=4)


def _searched(spark, sf):
    """(run for optimise's searches, a fresh table): a budget is a number of last folds, 0 all."""
    import json
    import uuid

    from palimpsest.sources.sinks import scratch, stored

    t = Tables(spark, sf)
    y = target(t).where("y is not null")
    folds = ev.folds(y, 10, 1)
    growth, y, folds = (stored(x) for x in (_growth(t), y, folds))
    n = folds.count()

    def run(configs, budget):
        rows = [(r.config_id, json.dumps(_config(json.loads(r.config)))) for r in configs.collect()]  # one batch of trials
        few = folds.where(F.col("fold") >= (n - budget if budget else 0))
        few = few.withColumn("fold", F.col("fold") - (max(0, n - budget) if budget else 0))
        made = spark.createDataFrame(rows, "config_id string, config string")
        return bt.scores(bt.run_all(growth, y, few, made, blocks=4)).select("config_id", F.col("rmse").alias("score"))

    return run, f"{scratch(spark)}/trials-{uuid.uuid4().hex}"


@query("bayesian_search")
def bayesian_search(spark, sf):
    from palimpsest.operators import optimise

    run, path = _searched(spark, sf)
    return optimise.bayesian_search(spark, _space(), run, 12, path, batch=6, startup=6)


@query("halving_search")
def halving_search(spark, sf):
    from palimpsest.operators import optimise

    run, path = _searched(spark, sf)
    return optimise.successive_halving(spark, _space(), run, 9, path, least=2, most=8, eta=2)
