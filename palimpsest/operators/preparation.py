"""Preparation of series for models: resampling, gaps, seasonality, stationarity, outliers, ragged edges, in that order.

Everything but the stationarity test is a plan over the long panel, partitioned by series. The test runs twice as a
grouped function: to find how many differences a series needs, and on what came of it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.operators import metadata, models
from palimpsest.operators import timeseries as ts
from palimpsest.sources.sinks import stored

PERIODS = {"month": 12, "quarter": 4}
REPORT = ["series_id", "mode", "dropped_reason", "transform_applied", "span_years", "initial_non_nan", "gaps_avg_1", "gaps_linear_23", "is_seasonal", "is_sa", "detect_reason", "d0_kpss_p", "diffs_used", "final_non_nan", "final_kpss_p", "status"]


def regular(panel: DataFrame, to: str = "month", rule: str = "last", most: int = 3) -> DataFrame:
    """The panel on a dense calendar, with filled (short gaps on a line) and gap (the length of a null's run)."""
    return ts.impute_gaps(ts.resample(panel, to, rule), most, "gap")


def first_look(dense: DataFrame, least: int = 8, least_years: float = 14.0) -> DataFrame:
    """series_id, span_years, initial_non_nan, gaps_avg_1, gaps_linear_23, dropped_reason before any transformation."""
    filled = lambda when: F.count_if(F.col("was_imputed") & when).alias
    known = F.when(F.col("value").isNotNull(), F.col("period_date"))
    d = dense.groupBy("series_id").agg(
        (F.coalesce(F.datediff(F.max(known), F.min(known)), F.lit(0)) / 365.25).alias("span_years"),
        F.count("value").alias("initial_non_nan"),
        filled(F.col("gap") == 1)("gaps_avg_1"),
        filled(F.col("gap") > 1)("gaps_linear_23"),
    )
    return d.withColumn("dropped_reason", F.when(F.col("span_years") < least_years, "too_short_span").when(F.col("initial_non_nan") < least, "too_few_obs_initial"))


def seasonality(dense: DataFrame, to: str = "month", meta: DataFrame | None = None, mode: str = "full") -> DataFrame:
    """series_id, is_seasonal, is_sa, detect_reason: by words of the series' texts (series_id, text), else by the
    autocorrelation of its differences at the season's lag (mode: full, fast, or metadata_only)."""
    lag = PERIODS[to]
    known = dense.where("filled is not null").select("series_id", "period_date", F.col("filled").alias("value"))
    acf = ts.seasonal_acf(known, lag).select("series_id", "n", "acf")
    share, seasons = (0.3, 3) if mode == "fast" else (0.2, 2)
    d = dense.select("series_id").distinct().join(acf, "series_id", "left")
    by_value = (F.col("n") + 1 > lag * seasons) & (F.col("n") > lag) & (F.col("acf") > share)
    by_value = F.lit(False) if mode == "metadata_only" else F.coalesce(by_value, F.lit(False))
    text = F.lit("")
    if meta is not None:
        d = d.join(meta.select("series_id", "text"), "series_id", "left")
        text = F.coalesce(F.lower("text"), F.lit(""))
    d = d.withColumn("said", metadata.seasonality(text))
    d = d.withColumns({"by_words": F.col("said") == "sa", "by_nsa": F.col("said") == "nsa"})
    seasonal = F.col("by_nsa") | (by_value & ~F.col("by_words"))
    reason = F.when(F.col("by_nsa"), "nsa_metadata").when(seasonal, f"acf_lag_{lag}_stat").when(F.col("by_words"), "sa_metadata").otherwise("no_strong_evidence")
    return d.select("series_id", seasonal.alias("is_seasonal"), (F.col("by_words") & ~seasonal).alias("is_sa"), reason.alias("detect_reason"))


def base_transformed(dense: DataFrame, decided: DataFrame, to: str = "month") -> DataFrame:
    """series_id, period_date, z: yearly differences of seasonal series, single ones of others; of logs where all values
    are positive. Differences go along the calendar, so a gap that is left makes gaps and shifts nothing."""
    lag = PERIODS[to]
    d = dense.join(decided.select("series_id", "is_seasonal"), "series_id")
    d = ts.safe_log(d, "logged", value="filled")
    w = ts.by_series()
    step = F.when(F.col("is_seasonal"), F.lag("logged", lag).over(w)).otherwise(F.lag("logged").over(w))
    return d.select("series_id", "period_date", (F.col("logged") - step).alias("z"))


def _tested(values: DataFrame, column: str, most: int, alpha: float) -> DataFrame:
    """series_id, p (of the values as they are), diffs_used."""

    def run(key, d: pd.DataFrame) -> pd.DataFrame:
        x = d.sort_values("period_date")[column].to_numpy(float)
        first = p = models.kpss(x)
        used = 0
        while p is not None and p < alpha and used < most:
            x, used = np.diff(x), used + 1
            p = models.kpss(x)
        return pd.DataFrame([(key[0], first, used)], columns=["series_id", "p", "diffs_used"])

    return values.select("series_id", "period_date", column).groupBy("series_id").applyInPandas(run, "series_id string, p double, diffs_used int")


def prepared(panel: DataFrame, to: str = "month", rule: str = "last", mixed: bool = False, most_diffs: int | None = None, alpha: float = 0.05, least: int = 8, least_years: float = 14.0, seasonal_mode: str = "full", meta: DataFrame | None = None, cache: DataFrame | None = None, ragged_limit: int | None = None, strict_compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """(REPORT's row for each series, series_id, period_date and value of those that stay).

    mixed: one further difference at most, no clipping, and a series that stays nonstationary is kept and said so.
    cache: series_id, obs_count, transform_applied, is_seasonal, is_sa, diffs_used of an earlier run; decisions hold while
    a series has grown by at most a tenth. ragged_limit: how far the last value is carried on; None not at all. Stages
    that several later ones read are stored in the shared folder, so that each runs once.
    """
    most_diffs = (1 if mixed else 2) if most_diffs is None else most_diffs
    dense = stored(regular(panel, to, rule))
    look = first_look(dense, least, least_years)
    going = dense.join(look.where("dropped_reason is null").select("series_id"), "series_id", "left_semi")
    found = seasonality(going, to, meta, seasonal_mode)
    if cache is not None:
        old = cache.select("series_id", "obs_count", F.col("is_seasonal").alias("c_seasonal"), F.col("is_sa").alias("c_sa"), F.col("diffs_used").alias("c_diffs"))
        found = found.join(look.select("series_id", "initial_non_nan"), "series_id").join(old, "series_id", "left")
        found = found.withColumn("cached", F.coalesce(F.col("initial_non_nan") <= F.col("obs_count") * 1.1, F.lit(False)))
        pick = lambda c, name: F.when(F.col("cached"), F.col(c)).otherwise(F.col(name)).alias(name)
        found = found.select("series_id", pick("c_seasonal", "is_seasonal"), pick("c_sa", "is_sa"), F.when(F.col("cached"), "loaded_from_cache").otherwise(F.col("detect_reason")).alias("detect_reason"), F.when(F.col("cached"), F.col("c_diffs")).alias("c_diffs"))
    else:
        found = found.withColumn("c_diffs", F.lit(None).cast("int"))
    base = stored(base_transformed(going, found, to))
    tested = _tested(base, "z", most_diffs, alpha)
    decided = stored(found.join(tested, "series_id").select("series_id", "is_seasonal", "is_sa", "detect_reason", F.when(F.col("c_diffs").isNull(), F.col("p")).alias("d0_kpss_p"), F.coalesce("c_diffs", "diffs_used").alias("diffs_used")))
    d, w = base.join(decided.select("series_id", "diffs_used"), "series_id"), W.partitionBy("series_id").orderBy("period_date")
    steps, now = [F.col("z")], F.col("z")
    for k in range(1, max(2, most_diffs) + 1):
        name = f"d{k}"
        d = d.withColumn(name, (F.col("z") - F.lag("z", k).over(w)) if strict_compat else (now - F.lag(now).over(w)))
        now = F.col(name)
        steps.append(now)
    value = steps[0]
    for k, step in enumerate(steps[1:], 1):
        value = F.when(F.col("diffs_used") == k, step).otherwise(value)
    d = d.select("series_id", "period_date", value.alias("value"))
    if not mixed:
        d = ts.winsorize(d, 0.01, 0.99).select("series_id", "period_date", F.col("clipped").alias("value"))
    if ragged_limit is not None:
        d = ts.fill_forward(d, ragged_limit).select("series_id", "period_date", F.col("filled").alias("value"))
    d = stored(d)
    flat = ts.almost_constant(d).select("series_id", F.col("n").alias("final_non_nan"), "constant")
    after = decided.join(flat, "series_id").join(_tested(d, "value", 0, alpha).select("series_id", F.col("p").alias("final_kpss_p")), "series_id")
    unsteady = F.col("final_kpss_p") < alpha
    reason = F.when(F.col("constant"), "almost_constant").when(F.col("final_non_nan") < least, "too_few_obs_final")
    reason = reason if mixed else reason.when(unsteady, "kpss_nonstationary_after_diffs")
    rule_name = F.when(F.col("is_seasonal"), f"yoy_diff_{PERIODS[to]}").otherwise("log_diff_1")
    report = look.withColumnRenamed("dropped_reason", "early").join(after.withColumn("late", reason), "series_id", "left")
    report = report.select(
        "series_id", F.lit("mixed_frequency" if mixed else "common_frequency").alias("mode"), F.coalesce("early", "late").alias("dropped_reason"),
        F.when(F.col("diffs_used").isNotNull(), rule_name).alias("transform_applied"), "span_years", "initial_non_nan", "gaps_avg_1", "gaps_linear_23",
        F.coalesce("is_seasonal", F.lit(False)).alias("is_seasonal"), F.coalesce("is_sa", F.lit(False)).alias("is_sa"), "detect_reason", "d0_kpss_p",
        F.coalesce("diffs_used", F.lit(0)).alias("diffs_used"), F.coalesce("final_non_nan", F.lit(0)).alias("final_non_nan"), "final_kpss_p",
        F.when(F.coalesce("early", "late").isNotNull(), "dropped").when(F.coalesce(unsteady, F.lit(False)), "nonstationary").otherwise("success").alias("status"),
    )
    return report, d.join(report.where("dropped_reason is null").select("series_id"), "series_id", "left_semi").where("value is not null")


def search_prepared(panel: DataFrame, how: str = "yoy", least: int = 36, least_years: float = 14.0) -> DataFrame:
    """series_id, period_date, value of search-interest series: monthly means, gaps filled, the level, its difference
    or its yearly difference (how: level, diff, yoy), clipped. Short series are left out before and after. What several
    later stages read is stored, as in prepared, so that no task holds all stages' windows at once."""
    steps = {"level": 0, "diff": 1, "yoy": 12}[how]
    dense = stored(regular(panel, "month", "mean"))
    look = first_look(dense, least, least_years).where("dropped_reason is null").select("series_id")
    d = dense.join(look, "series_id", "left_semi")
    moved = F.col("filled") - F.lag("filled", steps).over(ts.by_series()) if steps else F.col("filled")
    d = stored(ts.winsorize(d.select("series_id", "period_date", moved.alias("value"))).select("series_id", "period_date", F.col("clipped").alias("value")).where("value is not null"))
    enough = d.groupBy("series_id").agg(F.count("value").alias("n")).where(F.col("n") >= least).select("series_id")
    return d.join(enough, "series_id", "left_semi")


def assembled(monthly: DataFrame, quarterly: DataFrame, search: DataFrame, target: str, how: str = "yoy", **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(series_id, frequency, period_date, value of all that stay; series_id, frequency; period_date, y of the target).

    Monthly and quarterly series are prepared by their own calendars, search series by theirs and named with gt_; a date
    that one stream has and another lacks is simply a row less: the long form is their full outer join. The target is
    taken out of the quarterly stream, and y is its yearly log difference.
    """
    own = [k for k in ("least", "least_years") if k in options]
    streams = [
        prepared(monthly, "month", "mean", **options)[1].withColumn("frequency", F.lit("M")),
        prepared(quarterly.where(F.col("series_id") != target), "quarter", "mean", **options)[1].withColumn("frequency", F.lit("Q")),
        search_prepared(search.withColumn("series_id", F.concat(F.lit("gt_"), "series_id")), how, **{k: options[k] for k in own}).withColumn("frequency", F.lit("GT")),
    ]
    whole = stored(streams[0].unionByName(streams[1]).unionByName(streams[2]).select("series_id", "frequency", "period_date", "value"))
    y = ts.resample(quarterly.where(F.col("series_id") == target), "quarter", "mean")
    y = ts.seasonal_diff(y, 4, "y").where("y is not null").select("period_date", "y")
    return whole, whole.select("series_id", "frequency").distinct(), y
