"""Calendar resampling, dense grids, gap imputation and stationarity transforms on long panels.

A long panel has one row per series and period. Every operator takes the names of its series, date and value columns
and partitions by series alone, so that a chain of them reuses one shuffle and one sort. Values are null, never NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.periods import friday_week_end, month_end, quarter_end

SERIES, DATE, VALUE = "series_id", "period_date", "value"
STEPS = {"month": 1, "quarter": 3}


def by_series(series: str = SERIES, date: str = DATE) -> W:
    return W.partitionBy(series).orderBy(date)


def aggregate(rule: str, value: str = VALUE, date: str = DATE) -> Column:
    """mean; last (non-null by date); sum (null if all are); sum_zero (0 if all are)."""
    v = F.col(value)
    if rule == "last":
        return F.max_by(v, F.when(v.isNotNull(), F.col(date)))
    return {"mean": F.avg(v), "sum": F.sum(v), "sum_zero": F.coalesce(F.sum(v), F.lit(0.0))}[rule]


def dense(df: DataFrame, step: str = "month", series: str = SERIES, date: str = DATE) -> DataFrame:
    """All period ends of each series from its first to its last, with df's columns null where df has no row."""
    months = STEPS[step]
    ends = F.sequence(F.trunc("__lo", "MM"), F.trunc("__hi", "MM"), F.expr(f"interval {months} month"))
    grid = df.groupBy(series).agg(F.min(date).alias("__lo"), F.max(date).alias("__hi")).select(series, F.explode(ends).alias(date)).withColumn(date, F.last_day(date))
    return grid.join(df, [series, date], "left")


def resample(df: DataFrame, to: str = "month", rule: str = "mean", fill_grid: bool = True, series: str = SERIES, date: str = DATE, value: str = VALUE) -> DataFrame:
    """One row per series and period end (month, quarter, or week ending Friday), on a dense calendar for months and quarters."""
    end = {"month": month_end, "quarter": quarter_end, "week": friday_week_end}[to](F.col(date))
    out = df.withColumn("__end", end).groupBy(series, "__end").agg(aggregate(rule, value, date).alias(value)).withColumnRenamed("__end", date)
    return dense(out, to, series, date) if fill_grid and to != "week" else out


def impute_gaps(df: DataFrame, most: int = 3, run_length: str | None = None, series: str = SERIES, date: str = DATE, value: str = VALUE) -> DataFrame:
    """df (dense) with filled and was_imputed: runs of up to ``most`` nulls between two values on a straight line.

    A run of one becomes its neighbours' mean by the same formula; longer runs and runs at an edge stay null. run_length
    names a further column with the length of the run that a null is in.
    """
    w = by_series(series, date)
    before, after = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col("__n"))
    out = df.withColumn("__n", F.row_number().over(w))
    out = out.withColumns(
        {
            "__pv": F.last(value, True).over(before), "__pn": F.last(at, True).over(before),
            "__nv": F.first(value, True).over(after), "__nn": F.first(at, True).over(after),
        }
    )
    run = F.col("__nn") - F.col("__pn") - 1
    line = F.col("__pv") + (F.col("__nv") - F.col("__pv")) * (F.col("__n") - F.col("__pn")) / (run + 1)
    missing = F.col(value).isNull()
    out = out.withColumn("filled", F.when(~missing, F.col(value)).when(run.between(1, most), line))
    if run_length:
        out = out.withColumn(run_length, F.when(missing, run))
    return out.withColumn("was_imputed", missing & F.col("filled").isNotNull()).drop("__n", "__pv", "__pn", "__nv", "__nn")


def fill_forward(df: DataFrame, limit: int | None = None, out: str = "filled", series: str = SERIES, date: str = DATE, value: str = VALUE) -> DataFrame:
    first = W.unboundedPreceding if limit is None else -limit
    return df.withColumn(out, F.last(value, True).over(by_series(series, date).rowsBetween(first, 0)))


def fill_both(df: DataFrame, out: str = "filled", series: str = SERIES, date: str = DATE, value: str = VALUE) -> DataFrame:
    """Forward, then what leads the first value backward; meant for use inside a training window only."""
    w = by_series(series, date)
    return df.withColumn(out, F.coalesce(F.last(value, True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.first(value, True).over(w.rowsBetween(0, W.unboundedFollowing))))


def all_positive(series: str = SERIES, value: str = VALUE) -> Column:
    """Whether every value of the series is above 0."""
    return F.min(value).over(W.partitionBy(series)) > 0


def safe_log(df: DataFrame, out: str = "logged", series: str = SERIES, value: str = VALUE) -> DataFrame:
    """ln where the whole series is positive, else the value itself."""
    return df.withColumn(out, F.when(all_positive(series, value), F.ln(value)).otherwise(F.col(value)))


def seasonal_diff(df: DataFrame, k: int = 12, out: str = "diff", series: str = SERIES, date: str = DATE, value: str = VALUE) -> DataFrame:
    """The k-step difference, of logs where the whole series is positive."""
    d = safe_log(df, "__z", series, value)
    return d.withColumn(out, F.col("__z") - F.lag("__z", k).over(by_series(series, date))).drop("__z")


def difference(df: DataFrame, times: int = 1, out: str = "diff", strict_compat: bool = False, series: str = SERIES, date: str = DATE, value: str = VALUE) -> DataFrame:
    """Repeated first differences; with strict_compat one difference at lag ``times`` instead."""
    w = by_series(series, date)
    if strict_compat:
        return df.withColumn(out, F.col(value) - F.lag(value, times).over(w))
    d = df.withColumn(out, F.col(value))
    for _ in range(times):
        d = d.withColumn(out, F.col(out) - F.lag(out).over(w))
    return d


def winsorize(df: DataFrame, low: float = 0.01, high: float = 0.99, out: str = "clipped", series: str = SERIES, value: str = VALUE) -> DataFrame:
    """Values clipped to the series' exact quantiles."""
    bounds = df.groupBy(series).agg(F.percentile(value, F.array(F.lit(low), F.lit(high))).alias("__q"))
    d = df.join(bounds, series, "left")
    clipped = F.when(F.col(value).isNotNull(), F.greatest(F.least(F.col(value), F.col("__q")[1]), F.col("__q")[0]))
    return d.withColumn(out, clipped).drop("__q")


def lag_features(df: DataFrame, lags: tuple[int, ...] = (1, 3, 6), series: str = SERIES, date: str = DATE, value: str = VALUE) -> DataFrame:
    return df.withColumns({f"lag{k}": F.lag(value, k).over(by_series(series, date)) for k in lags})


def rolling(df: DataFrame, windows: tuple[int, ...] = (3, 6), series: str = SERIES, date: str = DATE, value: str = VALUE) -> DataFrame:
    """Rolling means (from one value on) and sample deviations (from two on)."""
    w = by_series(series, date)
    means = {f"mean{k}": F.avg(value).over(w.rowsBetween(1 - k, 0)) for k in windows}
    return df.withColumns(means | {f"std{k}": F.stddev_samp(value).over(w.rowsBetween(1 - k, 0)) for k in windows})


def seasonal_acf(df: DataFrame, lag: int = 12, series: str = SERIES, date: str = DATE, value: str = VALUE) -> DataFrame:
    """series, n, acf: the biased autocorrelation of first differences at the lag."""
    w = by_series(series, date)
    d = df.withColumn("__d", F.col(value) - F.lag(value).over(w)).where("__d is not null")
    d = d.withColumn("__c", F.col("__d") - F.avg("__d").over(W.partitionBy(series))).withColumn("__l", F.lag("__c", lag).over(w))
    return d.groupBy(series).agg(F.count("__c").alias("n"), F.try_divide(F.sum(F.col("__c") * F.col("__l")), F.sum(F.col("__c") * F.col("__c"))).alias("acf"))


def detect_frequency(df: DataFrame, series: str = SERIES, date: str = DATE) -> DataFrame:
    """series, n, frequency: Q when all dates lie in quarter-end months at least 80 days apart, and of 3 dates on; else M."""
    gap = F.datediff(F.col(date), F.lag(date).over(by_series(series, date)))
    d = df.select(series, date, gap.alias("__gap"))
    fits = F.every((F.month(date) % 3 == 0) & (F.coalesce(F.col("__gap"), F.lit(80)) >= 80))
    return d.groupBy(series).agg(F.count(F.lit(1)).alias("n"), fits.alias("__q")).select(series, "n", F.when((F.col("n") >= 3) & F.col("__q"), "Q").otherwise("M").alias("frequency"))


def almost_constant(df: DataFrame, series: str = SERIES, value: str = VALUE) -> DataFrame:
    """series, n, constant: fewer than 10 values or a population deviation under 1e-12."""
    return df.groupBy(series).agg(F.count(value).alias("n"), ((F.count(value) < 10) | (F.coalesce(F.stddev_pop(value), F.lit(0.0)) < 1e-12)).alias("constant"))


def span(df: DataFrame, series: str = SERIES, date: str = DATE, value: str = VALUE) -> DataFrame:
    """series, n (values), span_years between the first and the last value."""
    d = F.when(F.col(value).isNotNull(), F.col(date))
    return df.groupBy(series).agg(F.count(value).alias("n"), (F.datediff(F.max(d), F.min(d)) / 365.25).alias("span_years"))


def long_enough(df: DataFrame, least: int = 36, years: float = 14.0, series: str = SERIES, date: str = DATE, value: str = VALUE) -> DataFrame:
    """df's rows of series with enough values over enough years; placed before any costly per-series work."""
    return df.join(span(df, series, date, value).where((F.col("n") >= least) & (F.col("span_years") >= years)).select(series), series, "left_semi")


def varying(df: DataFrame, series: str = SERIES, value: str = VALUE) -> DataFrame:
    """df's rows of series with at least two different values."""
    keep = df.groupBy(series).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi")).where("__lo < __hi").select(series)
    return df.join(keep, series, "left_semi")


def interpolate_by_time(panel: DataFrame, limit: int = 3, series: str = "series_id", date: str = "period_date", value: str = "value", out: str = "filled") -> DataFrame:
    """Gaps between known values filled on the line through them, weighted by days; at most the first ``limit`` of a gap."""
    w = W.partitionBy(series).orderBy(date)
    before, after = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    known = lambda c: F.when(F.col(value).isNotNull(), c)
    d = panel.withColumn("__n", F.row_number().over(w))
    d = d.withColumns({
        "__pv": F.last(value, True).over(before), "__pd": F.last(known(F.col(date)), True).over(before), "__pn": F.last(known(F.col("__n")), True).over(before),
        "__nv": F.first(value, True).over(after), "__nd": F.first(known(F.col(date)), True).over(after),
    })
    line = F.col("__pv") + (F.col("__nv") - F.col("__pv")) * F.datediff(date, "__pd") / F.datediff("__nd", "__pd")
    return d.withColumn(out, F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("__n") - F.col("__pn") <= limit, line)).drop("__n", "__pv", "__pd", "__pn", "__nv", "__nd")
