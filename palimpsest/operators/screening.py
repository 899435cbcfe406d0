"""Feature screening on long panels: completeness, variance, correlations with a target, scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.operators.sizes import broadcast_if_small


def correlation(x: Column, y: Column) -> Column:
    """Pairwise-complete Pearson correlation; null for a constant side."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def screened(panel: DataFrame, series: str = "series_id", value: str = "value") -> DataFrame:
    """series, completeness, variance."""
    return panel.groupBy(series).agg((F.count(value) / F.count(F.lit(1))).alias("completeness"), F.var_samp(value).alias("variance"))


def correlations(panel: DataFrame, target: DataFrame, date: str = "period_date", series: str = "series_id", value: str = "value", y: str = "y") -> DataFrame:
    """series, n, corr with the target by date."""
    joined = panel.join(target.select(date, y), date)
    both = F.col(value).isNotNull() & F.col(y).isNotNull()
    return joined.groupBy(series).agg(F.count_if(both).alias("n"), correlation(F.col(value), F.col(y)).alias("corr"))


def target_scores(panel: DataFrame, target: DataFrame, least_n: int = 6, **names) -> DataFrame:
    """series, n, corr: correlations with the target, 0 where they are undefined or rest on fewer than least_n pairs."""
    d = correlations(panel, target, **names)
    return d.withColumn("corr", F.when(F.col("n") >= least_n, F.coalesce("corr", F.lit(0.0))).otherwise(0.0))


def top_n(scores: DataFrame, n: int, score: str = "corr", series: str = "series_id", within: list[str] = ()) -> DataFrame:
    """The n rows of largest absolute score (within each group), ties by series."""
    if not within:
        return scores.where(F.col(score).isNotNull()).orderBy(F.desc(F.abs(score)), series).limit(n)
    w = W.partitionBy(*within).orderBy(F.desc(F.abs(score)), series)
    return scores.where(F.col(score).isNotNull()).withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n).drop("__k")


def lagged_correlations(panel: DataFrame, target: DataFrame, most: int = 3, least_n: int = 6, date: str = "period_date", series: str = "series_id", value: str = "value", y: str = "y") -> DataFrame:
    """series, best: the largest absolute correlation with the target shifted by 0 .. most of its rows."""
    w = W.orderBy(date)  # the target is one low-frequency series
    shifted = target.select(date, *(F.lag(y, k).over(w).alias(f"y{k}") for k in range(most + 1)))
    joined = panel.join(broadcast_if_small(shifted), date)
    aggs = []
    for k in range(most + 1):
        both = F.col(value).isNotNull() & F.col(f"y{k}").isNotNull()
        aggs.append(F.when(F.count_if(both) >= least_n, F.abs(correlation(F.col(value), F.col(f"y{k}")))).alias(f"c{k}"))
    return joined.groupBy(series).agg(*aggs).select(series, F.greatest(*(f"c{k}" for k in range(most + 1))).alias("best"))


def median_filled_variance(panel: DataFrame, series: str = "series_id", value: str = "value") -> DataFrame:
    """series, variance (population) after nulls become the median, from one pass of sums."""
    a = panel.groupBy(series).agg(F.median(value).alias("m"), F.count(F.lit(1)).alias("n"), F.count(value).alias("c"), F.avg(value).alias("a"), F.var_pop(value).alias("v"))
    mean = (F.col("c") * F.col("a") + (F.col("n") - F.col("c")) * F.col("m")) / F.col("n")
    var = (F.col("c") * (F.col("v") + (F.col("a") - mean) ** 2) + (F.col("n") - F.col("c")) * (F.col("m") - mean) ** 2) / F.col("n")
    return a.select(series, var.alias("variance"))


def scaled(panel: DataFrame, series: str = "series_id", value: str = "value", out: str = "scaled") -> DataFrame:
    """Standardised values by the series' mean and population deviation after median filling; nulls stay null."""
    w = W.partitionBy(series)
    d = panel.withColumn("__f", F.coalesce(F.col(value), F.median(value).over(w)))
    return d.withColumn(out, F.when(F.col(value).isNotNull(), F.try_divide(F.col(value) - F.avg("__f").over(w), F.stddev_pop("__f").over(w)))).drop("__f")
