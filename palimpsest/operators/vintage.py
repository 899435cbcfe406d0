"""Pseudo-real-time vintages: what was knowable at a cutoff, for all cutoffs in one plan.

The table of cutoffs (target quarter, label, cutoff) is small by construction: quarters x labels. Panels are long,
so a vintage is a pair of extra key columns, and masking is a column expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.periods import quarter_end, vintage_cutoff
from palimpsest.operators.sizes import broadcast_if_small

LABELS = (-2, -1, 0, 1, 2)


def cutoffs(quarters: DataFrame, labels: tuple[int, ...] = LABELS) -> DataFrame:
    """target_quarter, label, cutoff for every row of quarters (target_quarter) and every label."""
    return quarters.withColumn("label", F.explode(F.array(*map(F.lit, labels)))).withColumn("cutoff", vintage_cutoff(F.col("target_quarter"), F.col("label")))


def release_lag(series: Column, frequency: Column, macro: int = 1, quarterly: int = 1, search: int = 0) -> Column:
    """Months until a value is published: search interest by flag or name first, then quarterly, then all others."""
    name = F.lower(series)
    is_search = (frequency == "GT") | name.startswith("gt_") | name.contains("_gt")
    return F.when(is_search, search).when(frequency == "Q", quarterly).otherwise(macro)


def visible(panel: DataFrame, cutoff_table: DataFrame, lag: str = "lag", date: str = "period_date", value: str = "value") -> DataFrame:
    """panel x cutoffs: rows up to each cutoff, values null that were not yet published.

    The condition bounds the product; the side of cutoffs is the small one and is broadcast by its size in the plan.
    """
    rows = panel.join(broadcast_if_small(cutoff_table), F.col(date) <= F.col("cutoff"))
    shown = F.when((F.col(lag) <= 0) | (F.col(date) <= F.last_day(F.add_months(F.col("cutoff"), -F.col(lag)))), F.col(value))
    return rows.withColumn(value, shown)


def visible_target(target: DataFrame, cutoff_table: DataFrame, days: int = 30, date: str = "period_date", value: str = "value") -> DataFrame:
    """target x cutoffs, null until ``days`` after each date."""
    rows = target.join(broadcast_if_small(cutoff_table), F.col(date) <= F.col("cutoff"))
    return rows.withColumn(value, F.when(F.date_add(date, days) <= F.col("cutoff"), F.col(value)))


def last_targets(masked: DataFrame, n: int, key: list[str] = ("target_quarter", "label"), date: str = "period_date", value: str = "value") -> DataFrame:
    """The last n available target rows of each vintage."""
    w = W.partitionBy(*key).orderBy(F.desc(date))
    return masked.where(F.col(value).isNotNull()).withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n).drop("__k")


def publication_filter(obs: DataFrame, cutoff: Column, frequency: str = "frequency", date: str = "period_date") -> DataFrame:
    """Rows older than the publication delay of their frequency: 60 days with Q, 30 with M, else none."""
    f = F.upper(frequency)
    return obs.where(F.col(date) <= F.date_sub(cutoff, F.when(f.contains("Q"), 60).when(f.contains("M"), 30).otherwise(0)))


def calendar_blocks(panel: DataFrame, series: str = "series_id", date: str = "period_date", value: str = "value") -> DataFrame:
    """series, quarter, m1, m2, m3: the quarter's months side by side."""
    d = panel.withColumn("quarter", quarter_end(F.col(date))).withColumn("__m", (F.month(date) - 1) % 3 + 1)
    return d.groupBy(series, "quarter").agg(*(F.max(F.when(F.col("__m") == k, F.col(value))).alias(f"m{k}") for k in (1, 2, 3)))


def most_recent(panel: DataFrame, k: int = 3, series: str = "series_id", date: str = "period_date", value: str = "value") -> DataFrame:
    """series, quarter, lag0 .. lag(k-1): the k latest non-null values up to each quarter end on which the panel has a row.

    The values are carried along one window in date order: linear, where a join on dates would be quadratic.
    """
    w = W.partitionBy(series).orderBy(date).rowsBetween(W.unboundedPreceding, 0)
    have = panel.where(F.col(value).isNotNull())
    tail = F.slice(F.reverse(F.collect_list(value).over(W.partitionBy(series).orderBy(date).rowsBetween(1 - k, 0))), 1, k)
    carried = panel.join(have.select(series, date, tail.alias("__t")), [series, date], "left").withColumn("__t", F.last("__t", True).over(w))
    ends = carried.where((F.col(date) == quarter_end(F.col(date))))
    return ends.select(series, F.col(date).alias("quarter"), *(F.try_element_at("__t", F.lit(i + 1)).alias(f"lag{i}") for i in range(k)))


def stacked(panel: DataFrame, k: int, series: str = "series_id", date: str = "period_date", value: str = "value") -> DataFrame:
    """series, date, stack: the last k rows' values of a dense panel, oldest first, null-padded on the left."""
    w = W.partitionBy(series).orderBy(date).rowsBetween(1 - k, 0)
    got = F.transform(F.collect_list(F.struct(value)).over(w), lambda s: s[value])
    return panel.withColumn("stack", F.concat(F.array_repeat(F.lit(None).cast("double"), F.lit(k) - F.size(got)), got))


def locf(masked: DataFrame, key: list[str], date: str = "period_date", value: str = "value") -> DataFrame:
    w = W.partitionBy(*key).orderBy(date).rowsBetween(W.unboundedPreceding, 0)
    return masked.withColumn("filled", F.last(value, True).over(w))


def recent_mean(panel: DataFrame, n: int = 12, series: str = "series_id", date: str = "period_date", value: str = "value") -> DataFrame:
    """series, last_value, recent_mean: of the last n non-null values."""
    w = W.partitionBy(series).orderBy(F.desc(date))
    top = panel.where(F.col(value).isNotNull()).withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n)
    return top.groupBy(series).agg(F.max_by(value, date).alias("last_value"), F.avg(value).alias("recent_mean"))


def build(panel: DataFrame, target: DataFrame, cutoff_table: DataFrame, fill: str = "locf", least_share: float = 0.0, days: int = 30, series: str = "series_id", date: str = "period_date", value: str = "value") -> DataFrame:
    """Every vintage in one plan: target_quarter, label, series, date, value, split; the target's series is "__target".

    panel has a release lag for each row; what was not published at the cutoff is null, then filled by the rule (none,
    locf: the last known value, mean: the series' mean in its vintage, arima: the months after the last known value by
    a seasonal ARIMA, then locf for gaps inside). A series whose known share of a vintage's rows is
    under least_share is left out of that vintage. The target is known ``days`` after its date; its row of the target
    quarter is there in any case and has no value. split is 'test' on the target quarter, else 'train'.
    """
    key = ["target_quarter", "label", series]
    seen = visible(panel, cutoff_table, date=date, value=value)
    own = W.partitionBy(*key)
    if least_share > 0:
        seen = seen.withColumn("__share", F.count(value).over(own) / F.count(F.lit(1)).over(own)).where(F.col("__share") >= least_share).drop("__share")
    if fill == "locf":
        seen = seen.withColumn(value, F.last(value, ignorenulls=True).over(own.orderBy(date)))
    elif fill == "mean":
        seen = seen.withColumn(value, F.coalesce(value, F.avg(value).over(own)))
    elif fill == "arima":
        seen = forecast_tails(seen, panel, key, series, date, value)
        seen = seen.withColumn(value, F.last(value, ignorenulls=True).over(own.orderBy(date)))
    elif fill != "none":
        raise ValueError("fill must be none, locf, mean or arima")
    known = visible_target(target, cutoff_table, days, date, value).where(F.col(date) < F.col("target_quarter")).select("target_quarter", "label", date, value)
    asked = cutoff_table.select("target_quarter", "label", F.col("target_quarter").alias(date), F.lit(None).cast("double").alias(value))
    rows = seen.select(*key, date, value).unionByName(known.unionByName(asked).select("target_quarter", "label", F.lit("__target").alias(series), date, value))
    return rows.withColumn("split", F.when(F.col(date) == F.col("target_quarter"), "test").otherwise("train"))


def forecast_tails(masked: DataFrame, panel: DataFrame, key: list[str], series: str = "series_id", date: str = "period_date", value: str = "value") -> DataFrame:
    """masked with the rows after each key's last known value forecast from the panel up to that value.

    Many vintages end a series at the same month: each month is forecast from once, as far as any vintage asks.
    """
    import numpy as np
    import pandas as pd

    from palimpsest.operators.arima import forecast

    known = F.max(F.when(F.col(value).isNotNull(), F.col(date)))
    ends = masked.groupBy(*key).agg(known.alias("__end"), F.max(date).alias("__until")).where("__end < __until")
    asks = ends.groupBy(series, "__end").agg(F.max("__until").alias("__until"))
    past = panel.where(F.col(value).isNotNull()).select((F.col(series)).alias("__s"), F.col(date).alias("__d"), F.col(value).cast("double").alias("__v"))

    def run(keys, asked: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        own = pd.Series(d["__v"].to_numpy(float), pd.DatetimeIndex(pd.to_datetime(d["__d"])).to_period("M")).sort_index()
        own = own[~own.index.duplicated(keep="last")]
        out = []
        for end, until in zip(pd.to_datetime(asked["__end"]), pd.to_datetime(asked["__until"])):
            to = end.to_period("M")
            head = own[own.index <= to]
            if len(head):
                head = head.reindex(pd.period_range(head.index[0], to, freq="M"))
            months = pd.date_range(end + pd.offsets.MonthEnd(1), until, freq="ME")
            values, _ = forecast(head.to_numpy(float), len(months))
            out += [(keys[0], end.date(), m.date(), float(v) if np.isfinite(v) else None) for m, v in zip(months, values)]
        return pd.DataFrame(out, columns=[series, "__end", date, "__forecast"])

    kind = masked.schema[series].dataType.simpleString()
    made = asks.groupBy(series).cogroup(past.groupBy("__s")).applyInPandas(run, f"{series} {kind}, __end date, {date} date, __forecast double")
    d = masked.join(ends.select(*key, "__end"), key, "left").join(made, [series, "__end", date], "left")
    return d.withColumn(value, F.coalesce(value, F.when(F.col(date) > F.col("__end"), F.col("__forecast")))).drop("__end", "__forecast")


def umidas(panel: DataFrame, ratio: int = 3, lags: int = 2, series: str = "series_id", date: str = "period_date", value: str = "value") -> DataFrame:
    """An unrestricted mixed-frequency design in long form: at each quarter's end, each of a series' ratio * lags latest
    monthly values is a series of its own, named with its lag. panel is on a dense calendar."""
    w = W.partitionBy(series).orderBy(date)
    stack = F.array(*(F.struct(F.lit(k).alias("k"), F.lag(value, k).over(w).alias("v")) for k in range(ratio * lags)))
    d = panel.select(series, date, stack.alias("__s")).where(F.month(date) % 3 == 0).select(series, date, F.explode("__s").alias("__x"))
    return d.select(F.concat(F.col(series), F.lit("@"), F.col("__x.k").cast("string")).alias(series), date, F.col("__x.v").alias(value))


def mixed_frequency(monthly: DataFrame, quarterly: DataFrame | None, target: str, series: str = "series_id", date: str = "period_date", value: str = "value") -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(monthly, quarterly, y): the target is taken out of the quarterly panel, else out of the monthly one as each
    quarter's last known value."""
    if quarterly is not None and not quarterly.where(F.col(series) == target).isEmpty():
        return monthly, quarterly.where(F.col(series) != target), quarterly.where((F.col(series) == target) & F.col(value).isNotNull()).select(date, value)
    from palimpsest.functions.periods import quarter_end

    own = monthly.where((F.col(series) == target) & F.col(value).isNotNull())
    y = own.groupBy(quarter_end(F.col(date)).alias("__q")).agg(F.max_by(value, date).alias(value)).select(F.col("__q").alias(date), value)
    return monthly.where(F.col(series) != target), quarterly, y
