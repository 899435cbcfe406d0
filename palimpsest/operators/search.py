"""Searches over configurations: which run, in what order, which are promoted, and what is reused from earlier runs."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def promoted(results: DataFrame, k: int, score: str = "rmse", tie: str = "config_id", status: str | None = None) -> DataFrame:
    """The k best results (smallest score, ties by config) that go on to the fine stage; failures never do."""
    d = results.where(F.col(score).isNotNull())
    d = d.where(F.col(status) == "success") if status else d
    return d.orderBy(score, tie).limit(k)


def success_first(results: DataFrame, score: str = "rmse", tie: str = "config_id", status: str = "status") -> DataFrame:
    """Successes by score, then failures, then ties by config."""
    return results.orderBy((F.col(status) != "success").cast("int"), F.col(score).asc_nulls_last(), tie)


def shuffled(configs: DataFrame, seed: int, most: int | None = None, key: str = "config_id") -> DataFrame:
    """configs in an order that only seed and key decide, and the first of them where there is a cap."""
    d = configs.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key)
    return d.limit(most) if most is not None else d


def forecast_order(predictions: DataFrame) -> DataFrame:
    """Prediction frames in their final order."""
    return predictions.orderBy("forecast_origin", "target_date")


def feasible_windows(n: Column, windows: list[int], least_tests: int = 5) -> Column:
    """The training windows that leave enough rows for tests; where none does, fixed shares of the rows."""
    fits = F.filter(F.array(*map(F.lit, windows)), lambda w: w < n - least_tests)
    shares = F.array_sort(F.array_distinct(F.array(*((n * s).cast("int") for s in (0.3, 0.5, 0.7)))))
    small = F.array(F.greatest(F.lit(5), n.cast("int") - least_tests - 1))
    return F.when(F.size(fits) > 0, fits).when(n > 15, shares).otherwise(small)


def frequency_ratio(panel: DataFrame, target: DataFrame, series: str = "series_id", date: str = "period_date") -> DataFrame:
    """series, ratio: how many of its periods fall in one of the target's, at least 1; 3 where either has under two dates."""
    gap = lambda: F.datediff(F.max(date), F.min(date)) / F.greatest(F.countDistinct(date) - 1, F.lit(1))
    low = target.agg(F.countDistinct(date).alias("n_low"), gap().alias("low"))
    high = panel.groupBy(series).agg(F.countDistinct(date).alias("n_high"), gap().alias("high"))
    ratio = F.greatest(F.lit(1), F.bround(F.col("low") / F.col("high")).cast("int"))
    return high.join(F.broadcast(low)).select(series, F.when((F.col("n_high") < 2) | (F.col("n_low") < 2), F.lit(3)).otherwise(ratio).alias("ratio"))  # one row beside every series


def completeness_cap(panel: DataFrame, target: str, most: int = 30, lags: int = 3, series: str = "series_id", date: str = "period_date", value: str = "value") -> DataFrame:
    """series, completeness of those that a vector autoregression may take.

    Series that lack half of all dates or more are out; of the others the most complete stay, as many as the number of
    dates allows for these lags (10 at least), and the target in any case.
    """
    n = F.broadcast(panel.agg(F.countDistinct(date).alias("dates")))  # one row
    d = panel.groupBy(series).agg(F.count(value).alias("known")).join(n).withColumn("completeness", F.col("known") / F.col("dates"))
    # The cap is at most ``most``, so a bounded top list is enough, whatever the number of series.
    best = d.where((F.col("completeness") > 0.5) & (F.col(series) != target)).orderBy(F.desc("completeness"), series).limit(most)
    safe = F.greatest(F.lit(10), F.least(F.lit(most), F.floor(F.greatest(F.col("dates"), F.lit(1)) / max(1, lags))))
    ranked = best.withColumn("k", F.row_number().over(W.orderBy(F.desc("completeness"), series))).where(F.col("k") < safe)
    return ranked.select(series, "completeness").unionByName(d.where(F.col(series) == target).select(series, "completeness"))


def parsed(column: Column, key: str) -> Column:
    """The key's value where the text is a JSON object, else the text itself."""
    found = F.get_json_object(column, f"$.{key}")
    return F.when(F.try_parse_json(column).isNotNull() & column.startswith("{"), found).otherwise(column)


def run_suffix(parts: dict, most: int = 180) -> str:
    """A file-name part that tells a run's options, of at most so many characters."""
    text = "_".join(f"{k}-{v}" for k, v in parts.items() if v not in (None, "", False))
    return re.sub(r"[^A-Za-z0-9_.-]+", "-", text)[:most].rstrip("_-")


def signature(options: dict) -> str:
    return json.dumps(options, sort_keys=True, default=str)


def resumable(results: DataFrame, options: dict, column: str = "run_signature") -> DataFrame:
    """The results of a run with just these options; results of any other run are not resumed."""
    return results.where(F.col(column) == signature(options))


def save_manifest(spark: SparkSession, path: str, options: dict) -> None:
    """The run's options as one JSON line beside its results."""
    spark.createDataFrame([(signature(options),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def cache_keys(panel: DataFrame, dataset: str, steps: int, series: str = "series_id", date: str = "period_date", value: str = "value") -> DataFrame:
    """series, last_date, cache_key: a digest of dataset, series, horizon and every value, in the order of dates."""
    values = F.array_sort(F.collect_list(F.struct(F.col(date), F.col(value).cast("decimal(38,6)").cast("string").alias("v"))))
    d = panel.groupBy(series).agg(F.max(date).alias("last_date"), F.array_join(F.transform(values, lambda x: F.coalesce(x["v"], F.lit("null"))), ",").alias("all"))
    return d.select(series, "last_date", F.md5(F.concat_ws("|", F.lit(dataset), F.col(series), F.lit(str(steps)), F.col("last_date").cast("string"), F.col("all"))).alias("cache_key"))


def from_cache(keys: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(forecasts that the cache has, keys that must be forecast anew)."""
    return cache.join(keys.select("cache_key"), "cache_key"), keys.join(cache.select("cache_key").distinct(), "cache_key", "left_anti")
