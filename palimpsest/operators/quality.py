"""Data-quality monitors over the catalogue and the observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.operators.sizes import broadcast_if_small


def gaps(obs: DataFrame, series: str = "series_id", date: str = "period_date", days: int = 95) -> DataFrame:
    """series, gap_start, gap_end, gap_days of steps between a series' dates longer than ``days``."""
    w = W.partitionBy(series).orderBy(date)
    d = obs.select(series, F.col(date).alias("gap_end"), F.lag(date).over(w).alias("gap_start"))
    return d.withColumn("gap_days", F.datediff("gap_end", "gap_start")).where(F.col("gap_days") > days)


def flatlines(obs: DataFrame, series: str = "series_id", date: str = "period_date", value: str = "value", share: float = 0.5, least: int = 10) -> DataFrame:
    """series, n, pct_repeated of series in which over ``share`` of more than ``least`` values repeat the one before."""
    d = obs.withColumn("__p", F.lag(value).over(W.partitionBy(series).orderBy(date)))
    d = d.groupBy(series).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(value) == F.col("__p")).alias("r"))
    return d.where((F.col("n") > least) & (F.col("r") > share * F.col("n"))).select(series, "n", F.round(100 * F.col("r") / F.col("n"), 1).alias("pct_repeated"))


def stale(freshness: DataFrame, thresholds: DataFrame, now: Column, default_hours: int = 200) -> DataFrame:
    """source, hours, status (never_run, stale, fresh)."""
    d = freshness.join(broadcast_if_small(thresholds), "source", "left")
    hours = (F.unix_timestamp(now) - F.unix_timestamp("last_run")) / 3600.0
    d = d.withColumn("hours", hours)
    return d.select("source", "hours", F.when(F.col("last_run").isNull(), "never_run").when(F.col("hours") > F.coalesce("limit_hours", F.lit(default_hours)), "stale").otherwise("fresh").alias("status"))


def search(df: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Rows in which any of the columns holds the needle, whatever its case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.col(c).ilike(f"%{needle}%")
    return df.where(hit)


def classify_raw(raw: Column, status: Column) -> tuple[Column, Column]:
    """(value, reason): blank and dash are missing, a comma may be the decimal sign, status dydis0 means zero."""
    text = F.trim(raw)
    number = F.regexp_replace(text, ",", ".").try_cast("double")
    blank = raw.isNull() | text.isin("", "-")
    zero = F.lower(F.coalesce(status, F.lit(""))) == "dydis0"
    value = F.when(zero, F.lit(0.0)).when(~blank, number)
    reason = F.when(zero, "zero_status").when(blank, "blank").when(number.isNull(), "not_numeric").otherwise("ok")
    return value, reason


def input_problems(panel: DataFrame, target_dates: DataFrame, series: str = "series_id", date: str = "period_date", value: str = "value") -> DataFrame:
    """series, problem: 'all_null', 'no_overlap' with the target's dates, or null for a series fit as a model's input."""
    known = F.col(value).isNotNull()
    d = panel.join(target_dates.select(date).distinct().withColumn("__t", F.lit(True)), date, "left").groupBy(series).agg(F.count(value).alias("n"), F.count_if(known & F.col("__t")).alias("met"))
    return d.select(series, F.when(F.col("n") == 0, "all_null").when(F.col("met") == 0, "no_overlap").alias("problem"))
