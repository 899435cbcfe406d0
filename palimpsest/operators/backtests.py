"""Rolling back-tests and searches over configurations, as one plan of folds and configurations.

The panel goes once to each block of neighbouring folds, where it becomes one wide frame; folds and configurations are
small keys beside it. What is shuffled grows with the panel and the number of blocks, not with folds x configurations.
Selectors, compressors, fillings and scalings are learnt from a fold's training rows alone.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.operators import selectors as sl
from palimpsest.operators.evaluation import accuracy
from palimpsest.operators.models import MODELS, Model
from palimpsest.operators.search import promoted
from palimpsest.operators.sizes import broadcast_if_small
from palimpsest.sources.sinks import stored

SCHEMA = "config_id string, fold int, target_date date, model string, actual double, predicted double, n_features int, n_selected int, status string"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
TARGET = "__target"


def model_class(name: str) -> type[Model]:
    if name == "dynamic_factor":
        from palimpsest.operators.factor_model import DynamicFactor

        return DynamicFactor
    if name == "mixed_factor":
        from palimpsest.operators.mixed_factor import MixedFactor

        return MixedFactor
    if name == "boosted_trees":
        from palimpsest.operators.boosting import BoostedTrees

        return BoostedTrees
    return MODELS[name]


def by_target(wide: pd.DataFrame, dates: np.ndarray, rule: str) -> pd.DataFrame:
    """A row for each target date: each column's mean (or last value) since the target date before."""
    period = np.searchsorted(dates, wide.index.to_numpy())
    inside = period < len(dates)
    grouped = wide[inside].groupby(period[inside])
    out = grouped.mean() if rule == "mean" else grouped.last()
    out = out.reindex(range(len(dates)))
    out.index = pd.DatetimeIndex(dates)
    return out


def run_fold(wide: pd.DataFrame, since, train_end, test_end, config: dict) -> tuple[pd.DataFrame, int, int, str]:
    """(actual and predicted by target date, n_features, n_selected, status) of one configuration on one fold.

    wide: dates x series, with the target as TARGET; rows from ``since`` on count. Models that accept gaps get every row,
    others a row for each target.
    """
    w = wide.loc[pd.Timestamp(since) : pd.Timestamp(test_end)]
    y = w[TARGET].dropna()
    dates = y.index.to_numpy()
    end = np.datetime64(pd.Timestamp(train_end))
    test, n, kept = dates[dates > end], 0, 0
    try:
        kind = model_class(config["model"])
        monthly = w.drop(columns=TARGET)
        x = by_target(monthly, dates, config.get("rule", "mean"))
        window = config.get("window")
        train = np.flatnonzero(dates <= end)[-window if window else 0 :]
        known = x.iloc[train].notna().sum() > 1
        x, n = x.loc[:, known], int(known.sum())
        if len(train) < 5 or n == 0:
            raise ValueError("too little data")
        chain = sl.Chain(config.get("selectors", ())).fit(x.to_numpy(float)[train], y.to_numpy(float)[train])
        if getattr(kind, "gaps", False):
            rows = monthly.loc[:, known] if not train[0] else monthly.loc[pd.Timestamp(dates[train[0] - 1]) + pd.Timedelta(days=1) :, known]
            inside = rows.index.to_numpy() <= end
            z, target = chain.transform(rows.to_numpy(float)), w.loc[rows.index, TARGET].to_numpy(float)
            model = kind(**config.get("params", {})).fit(z[inside], target[inside])
            out = pd.Series(model.predict(z[~inside]), index=rows.index[~inside]).reindex(test).to_numpy()
        else:
            z = chain.transform(x.to_numpy(float))
            model = kind(**config.get("params", {})).fit(z[train], y.to_numpy(float)[train])
            out = model.predict(z[dates > end])
        kept, status = z.shape[1], "success"
    except (ValueError, np.linalg.LinAlgError) as e:
        out, status = np.full(len(test), np.nan), f"failed: {e}"
    return pd.DataFrame({"actual": y.loc[test].to_numpy(), "predicted": out}, index=pd.DatetimeIndex(test)), n, kept, status


def run_all(panel: DataFrame, target: DataFrame, folds: DataFrame, configs: DataFrame, blocks: int = 16, lanes: int = 1, series: str = "series_id", date: str = "period_date", value: str = "value", y: str = "y") -> DataFrame:
    """SCHEMA's rows of every configuration (config_id, config as JSON) on every fold.

    blocks: groups of neighbouring folds; lanes: groups of configurations. A task has one of each. A fold's first target
    takes in what lies between the target before it and itself.
    """
    calendar = target.where(F.col(y).isNotNull()).select(F.col(date).alias("train_start")).distinct()
    calendar = calendar.select("train_start", F.coalesce(F.lag("train_start").over(W.orderBy("train_start")), F.lit("1700-01-01").cast("date")).alias("since"))  # one target's dates
    folds = folds.select("fold", "train_start", "train_end", "test_end").join(calendar, "train_start", "left")
    folds = folds.withColumn("since", F.coalesce("since", F.date_sub("train_start", 1)))
    most = folds.agg((F.max("fold") + 1).alias("n"), F.lit(1).alias("one"))
    placed = folds.withColumn("one", F.lit(1)).join(F.broadcast(most), "one").withColumn("block", F.floor(F.col("fold") * F.least(F.lit(blocks), F.col("n")) / F.col("n")).cast("int"))
    spans = broadcast_if_small(placed.groupBy("block").agg(F.min("since").alias("first"), F.max("test_end").alias("last")))
    both = panel.select(F.col(series).cast("string").alias("series"), F.col(date).alias("date"), F.col(value).cast("double").alias("value"))
    both = both.unionByName(target.select(F.lit(TARGET).alias("series"), F.col(date).alias("date"), F.col(y).cast("double").alias("value"))).where("value is not null")
    both = both.join(spans, (F.col("date") > F.col("first")) & (F.col("date") <= F.col("last")))
    both = both.select((F.col("block") + 0).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), "series", "date", "value")
    tasks = placed.join(broadcast_if_small(configs.select("config_id", "config", F.lit(1).alias("one"))), "one")
    tasks = tasks.withColumn("lane", F.pmod(F.xxhash64("config_id"), F.lit(lanes)).cast("int")).select("block", "lane", "config_id", "config", "fold", F.date_add("since", 1).alias("since"), "train_end", "test_end")

    def run(key, jobs: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if not len(d) or not (d["series"] == TARGET).any():
            return pd.DataFrame(columns=NAMES)
        d["date"] = pd.to_datetime(d["date"])
        wide = d.pivot_table(index="date", columns="series", values="value", aggfunc="last").sort_index()
        out = []
        for job in jobs.sort_values(["config_id", "fold"]).itertuples():
            config = json.loads(job.config)
            rows, n, kept, status = run_fold(wide, job.since, job.train_end, job.test_end, config)
            out += [(job.config_id, job.fold, i.date(), config["model"], a, None if np.isnan(p) else float(p), n, kept, status) for i, a, p in rows.itertuples()]
        return pd.DataFrame(out, columns=NAMES)

    return tasks.groupBy("block", "lane").cogroup(both.groupBy("block", "lane")).applyInPandas(run, SCHEMA)


def config_rows(spark, configs: list[dict]) -> DataFrame:
    """config_id, config (JSON): the id is the text's md5."""
    import hashlib

    texts = [json.dumps(c, sort_keys=True) for c in configs]
    return spark.createDataFrame([(hashlib.md5(t.encode()).hexdigest(), t) for t in texts], "config_id string, config string")


def backtest(panel: DataFrame, target: DataFrame, folds: DataFrame, model: str, params: dict | None = None, selectors: tuple = (), rule: str = "mean", series: str = "series_id", date: str = "period_date", value: str = "value", y: str = "y") -> DataFrame:
    """fold, target_date, model, actual, predicted, n_features, n_selected, status of one model.

    The panel may be of a higher frequency than the target: factor models see all its rows, others each column's mean
    since the last target (rule: or its last value). selectors: (name, options) pairs, applied in turn.
    """
    configs = config_rows(panel.sparkSession, [{"model": model, "params": params or {}, "selectors": [list(s) for s in selectors], "rule": rule}])
    return run_all(panel, target, folds, configs, series=series, date=date, value=value, y=y).drop("config_id")


def scores(results: DataFrame) -> DataFrame:
    """config_id, n_obs, rmse, mae, mape, failures; a configuration that failed on any fold has no rmse."""
    failed = F.count_if(F.col("status") != "success")
    d = results.groupBy("config_id").agg(*accuracy(F.col("actual"), F.col("predicted")), failed.alias("failures"))
    return d.withColumn("rmse", F.when(F.col("failures") == 0, F.col("rmse")))


def staged_search(panel: DataFrame, target: DataFrame, folds: DataFrame, configs: DataFrame, top: int = 5, coarse_folds: int = 3, **options) -> DataFrame:
    """config_id, stage, n_obs, rmse, mae, mape, failures: all configurations on the last folds, the best ones on all."""
    last = folds.agg(F.max("fold").alias("last"), F.lit(1).alias("one"))
    few = folds.withColumn("one", F.lit(1)).join(F.broadcast(last), "one").where(F.col("fold") > F.col("last") - coarse_folds)
    few = few.withColumn("fold", F.col("fold") - F.greatest(F.col("last") - coarse_folds + 1, F.lit(0)))
    coarse = stored(scores(run_all(panel, target, few, configs, **options)))
    best = promoted(coarse, top).select("config_id")
    fine = scores(run_all(panel, target, folds, configs.join(F.broadcast(best), "config_id", "left_semi"), **options))
    return coarse.withColumn("stage", F.lit("coarse")).unionByName(fine.withColumn("stage", F.lit("fine")))
