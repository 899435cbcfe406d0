"""Resampling, imputation and transform queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions.periods import quarter_label
from palimpsest.operators import timeseries as ts
from palimpsest.plans.base import GAPPY, GAPPY_DENSE, PANEL, QEND, Tables, gappy, panel, query

W = "WINDOW w AS (PARTITION BY series_id ORDER BY period_date)"
r6 = lambda c, name=None: F.round(c, 6).alias(name or c)

DAILY = "SELECT l_returnflag AS series_id, CAST(l_shipdate AS DATE) AS period_date, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS value FROM lineitem GROUP BY ALL"


def daily(t: Tables):
    d = t.lineitem.select(F.col("l_returnflag").alias("series_id"), F.col("l_shipdate").cast("date").alias("period_date"), F.col("l_quantity").cast("decimal(18,2)").alias("q"))
    return d.groupBy("series_id", "period_date").agg(F.sum("q").cast("double").alias("value"))


@query("top_movers", f"""SELECT series_id, period_date, round(yoy, 6) AS yoy FROM (
  SELECT series_id, period_date, ln(value) - lag(ln(value), 12) OVER (PARTITION BY series_id ORDER BY period_date) AS yoy FROM ({PANEL}))
  WHERE yoy IS NOT NULL ORDER BY abs(yoy) DESC, series_id, period_date LIMIT 20""")
def top_movers(spark, sf):
    d = ts.seasonal_diff(ts.resample(panel(Tables(spark, sf)), "month", "sum"), 12, "yoy").where("yoy is not null")
    return d.orderBy(F.desc(F.abs("yoy")), "series_id", "period_date").limit(20).select("series_id", "period_date", r6("yoy"))


def _resampled(name, to, rule, sql):
    @query(name, sql)
    def run(spark, sf, to=to, rule=rule):
        d = ts.resample(daily(Tables(spark, sf)), to, rule, fill_grid=False)
        return d.select("series_id", "period_date", r6("value"))


_resampled("month_mean", "month", "mean", f"SELECT series_id, last_day(period_date) AS period_date, round(avg(value), 6) AS value FROM ({DAILY}) GROUP BY 1, 2")
_resampled("month_last", "month", "last", f"SELECT series_id, last_day(period_date) AS period_date, round(arg_max(value, period_date), 6) AS value FROM ({DAILY}) GROUP BY 1, 2")
_resampled("month_sum", "month", "sum", f"SELECT series_id, last_day(period_date) AS period_date, round(sum(value), 6) AS value FROM ({DAILY}) GROUP BY 1, 2")
_resampled("month_to_quarter", "quarter", "mean", f"SELECT series_id, {QEND.format(d='period_date')} AS period_date, round(avg(value), 6) AS value FROM ({DAILY}) GROUP BY 1, 2")
_resampled("week_friday_mean", "week", "mean", f"SELECT series_id, CAST(period_date + CAST((12 - isodow(period_date)) % 7 AS INTEGER) AS DATE) AS period_date, round(avg(value), 6) AS value FROM ({DAILY}) GROUP BY 1, 2")


@query("weekly_to_month", f"SELECT series_id, CAST(date_trunc('month', wk) AS DATE) AS period_date, round(avg(value), 6) AS value FROM (SELECT series_id, CAST(period_date + CAST((12 - isodow(period_date)) % 7 AS INTEGER) AS DATE) AS wk, avg(value) AS value FROM ({DAILY}) GROUP BY 1, 2) GROUP BY 1, 2")
def weekly_to_month(spark, sf):
    weeks = ts.resample(daily(Tables(spark, sf)), "week", "mean")
    return weeks.groupBy("series_id", F.trunc("period_date", "MM").alias("period_date")).agg(r6(F.avg("value"), "value"))


@query("quarter_to_month_sparse", f"""WITH q AS (SELECT series_id, {QEND.format(d='period_date')} AS period_date, sum(value) AS value FROM ({PANEL}) GROUP BY 1, 2)
  SELECT g.series_id, g.period_date, round(q.value, 6) AS value FROM (SELECT series_id, last_day(CAST(unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), INTERVAL 1 MONTH)) AS DATE)) AS period_date
    FROM (SELECT series_id, min(period_date) AS lo, max(period_date) AS hi FROM q GROUP BY 1)) g LEFT JOIN q USING (series_id, period_date)""")
def quarter_to_month_sparse(spark, sf):
    q = ts.resample(panel(Tables(spark, sf)), "quarter", "sum")
    return ts.dense(q, "month").select("series_id", "period_date", r6("value"))


@query("sum_null_zero", f"""SELECT series_id, {QEND.format(d='period_date')} AS quarter, round(coalesce(sum(value), 0), 6) AS sum_zero, round(sum(value), 6) AS sum_null FROM ({GAPPY_DENSE}) GROUP BY 1, 2""")
def sum_null_zero(spark, sf):
    from palimpsest.functions.periods import quarter_end

    d = ts.dense(gappy(Tables(spark, sf)))
    return d.groupBy("series_id", quarter_end(F.col("period_date")).alias("quarter")).agg(r6(ts.aggregate("sum_zero"), "sum_zero"), r6(ts.aggregate("sum"), "sum_null"))


@query("monthend_dedupe", "SELECT o_custkey AS series_id, last_day(CAST(o_orderdate AS DATE)) AS period_date, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY 1, 2")
def monthend_dedupe(spark, sf):
    o = Tables(spark, sf).orders
    return o.groupBy(F.col("o_custkey").alias("series_id"), F.last_day(F.col("o_orderdate").cast("date")).alias("period_date")).agg(F.round(F.avg("o_totalprice"), 4).alias("value"))


@query("dense_calendar", f"SELECT series_id, count(*) AS n, count(value) AS n_values, min(period_date) AS lo, max(period_date) AS hi FROM ({GAPPY_DENSE}) GROUP BY 1")
def dense_calendar(spark, sf):
    return ts.dense(gappy(Tables(spark, sf))).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_values"), F.min("period_date").alias("lo"), F.max("period_date").alias("hi"))


IMPUTED = f"""
  SELECT series_id, period_date, value, CASE WHEN value IS NOT NULL THEN value WHEN nn - pn - 1 BETWEEN 1 AND 3 THEN pv + (nv - pv) * (n - pn) / (nn - pn) END AS filled FROM (
    SELECT *, last_value(value IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN value IS NOT NULL THEN n END IGNORE NULLS) OVER b AS pn,
           first_value(value IGNORE NULLS) OVER a AS nv, first_value(CASE WHEN value IS NOT NULL THEN n END IGNORE NULLS) OVER a AS nn
    FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY period_date) AS n FROM ({GAPPY_DENSE}))
    WINDOW b AS (PARTITION BY series_id ORDER BY period_date ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY series_id ORDER BY period_date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
"""


@query("impute_gaps", f"SELECT series_id, period_date, round(filled, 4) AS filled, value IS NULL AND filled IS NOT NULL AS was_imputed FROM ({IMPUTED})")
def impute_gaps(spark, sf):
    return ts.impute_gaps(ts.dense(gappy(Tables(spark, sf)))).select("series_id", "period_date", F.round("filled", 4).alias("filled"), "was_imputed")


@query("ffill_limit", f"SELECT series_id, period_date, round(last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY period_date ROWS 2 PRECEDING), 4) AS filled FROM ({GAPPY_DENSE})")
def ffill_limit(spark, sf):
    return ts.fill_forward(ts.dense(gappy(Tables(spark, sf))), 2).select("series_id", "period_date", F.round("filled", 4).alias("filled"))


@query("ffill_all", f"SELECT series_id, period_date, round(last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY period_date ROWS UNBOUNDED PRECEDING), 4) AS filled FROM ({GAPPY_DENSE})")
def ffill_all(spark, sf):
    return ts.fill_forward(ts.dense(gappy(Tables(spark, sf)))).select("series_id", "period_date", F.round("filled", 4).alias("filled"))


@query("ffill_bfill", f"""WITH m AS (SELECT series_id, period_date, CASE WHEN month(period_date) IN (1, 2) THEN NULL ELSE value END AS value FROM ({GAPPY_DENSE}))
  SELECT series_id, period_date, round(coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY period_date ROWS UNBOUNDED PRECEDING),
    first_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY period_date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 4) AS filled FROM m""")
def ffill_bfill(spark, sf):
    d = ts.dense(gappy(Tables(spark, sf))).withColumn("value", F.when(~F.month("period_date").isin(1, 2), F.col("value")))
    return ts.fill_both(d).select("series_id", "period_date", F.round("filled", 4).alias("filled"))


@query("yoy_logdiff", f"SELECT series_id, period_date, round(CASE WHEN min(value) OVER (PARTITION BY series_id) > 0 THEN ln(value) - lag(ln(value), 12) OVER w ELSE value - lag(value, 12) OVER w END, 6) AS diff FROM ({GAPPY_DENSE}) {W}")
def yoy_logdiff(spark, sf):
    return ts.seasonal_diff(ts.dense(gappy(Tables(spark, sf))), 12).select("series_id", "period_date", r6("diff"))


CENTRED = "SELECT series_id, period_date, value - CASE WHEN series_id LIKE 'A%' THEN 1e7 ELSE 0 END AS value FROM (" + PANEL + ")"


@query("safe_log_diff", f"SELECT series_id, period_date, round(z, 6) AS logged, round(z - lag(z) OVER w, 6) AS diff FROM (SELECT *, CASE WHEN min(value) OVER (PARTITION BY series_id) > 0 THEN CASE WHEN value > 0 THEN ln(value) END ELSE value END AS z FROM ({CENTRED})) {W}")
def safe_log_diff(spark, sf):
    d = panel(Tables(spark, sf)).withColumn("value", F.col("value") - F.when(F.col("series_id").startswith("A"), 1e7).otherwise(0.0))
    d = ts.safe_log(d, "z")
    return ts.difference(d, value="z").select("series_id", "period_date", r6("z", "logged"), r6("diff"))


@query("second_diff", f"""SELECT series_id, period_date, round(d - lag(d) OVER w, 4) AS diff, round(lag2, 4) AS lag2 FROM (
  SELECT *, value - lag(value) OVER w AS d, value - lag(value, 2) OVER w AS lag2 FROM ({PANEL}) {W}) {W}""")
def second_diff(spark, sf):
    d = ts.difference(panel(Tables(spark, sf)), 2)
    return ts.difference(d, 2, "lag2", strict_compat=True).select("series_id", "period_date", F.round("diff", 4).alias("diff"), F.round("lag2", 4).alias("lag2"))


@query("winsorize", f"SELECT series_id, period_date, round(greatest(least(value, hi), lo), 4) AS clipped FROM ({PANEL}) JOIN (SELECT series_id, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM ({PANEL}) GROUP BY 1) USING (series_id)")
def winsorize(spark, sf):
    return ts.winsorize(panel(Tables(spark, sf))).select("series_id", "period_date", F.round("clipped", 4).alias("clipped"))


@query("seasonal_acf", f"""WITH d AS (SELECT series_id, period_date, d - avg(d) OVER (PARTITION BY series_id) AS c FROM (SELECT series_id, period_date, value - lag(value) OVER w AS d FROM ({PANEL}) {W}) WHERE d IS NOT NULL)
  SELECT series_id, count(*) AS n, round(sum(c * l) / sum(c * c), 6) AS acf FROM (SELECT *, lag(c, 12) OVER w AS l FROM d {W}) GROUP BY 1""")
def seasonal_acf(spark, sf):
    return ts.seasonal_acf(panel(Tables(spark, sf))).select("series_id", "n", r6("acf"))


@query("freq_detect", f"""WITH q AS (SELECT series_id, period_date FROM ({PANEL}) UNION ALL SELECT 'q' || series_id, {QEND.format(d='period_date')} FROM ({PANEL}) GROUP BY 1, 2)
  SELECT series_id, count(*) AS n, CASE WHEN count(*) >= 3 AND bool_and(month(period_date) % 3 = 0 AND coalesce(gap, 80) >= 80) THEN 'Q' ELSE 'M' END AS frequency
  FROM (SELECT *, period_date - lag(period_date) OVER w AS gap FROM q {W}) GROUP BY 1""")
def freq_detect(spark, sf):
    p = panel(Tables(spark, sf))
    q = ts.resample(p, "quarter", "sum", fill_grid=False).withColumn("series_id", F.concat(F.lit("q"), "series_id"))
    return ts.detect_frequency(p.unionByName(q))


@query("lag_features", f"SELECT series_id, period_date, round(lag(value, 1) OVER w, 4) AS lag1, round(lag(value, 3) OVER w, 4) AS lag3, round(lag(value, 6) OVER w, 4) AS lag6 FROM ({PANEL}) {W}")
def lag_features(spark, sf):
    d = ts.lag_features(panel(Tables(spark, sf)))
    return d.select("series_id", "period_date", *(F.round(f"lag{k}", 4).alias(f"lag{k}") for k in (1, 3, 6)))


@query("rolling_mean", f"SELECT series_id, period_date, round(avg(value) OVER (PARTITION BY series_id ORDER BY period_date ROWS 2 PRECEDING), 4) AS mean3, round(avg(value) OVER (PARTITION BY series_id ORDER BY period_date ROWS 5 PRECEDING), 4) AS mean6 FROM ({PANEL})")
def rolling_mean(spark, sf):
    return ts.rolling(panel(Tables(spark, sf))).select("series_id", "period_date", F.round("mean3", 4).alias("mean3"), F.round("mean6", 4).alias("mean6"))


@query("rolling_std", f"SELECT series_id, period_date, round(stddev_samp(value) OVER (PARTITION BY series_id ORDER BY period_date ROWS 2 PRECEDING), 1) AS std3, round(stddev_samp(value) OVER (PARTITION BY series_id ORDER BY period_date ROWS 5 PRECEDING), 1) AS std6 FROM ({PANEL})")
def rolling_std(spark, sf):
    return ts.rolling(panel(Tables(spark, sf))).select("series_id", "period_date", F.round("std3", 1).alias("std3"), F.round("std6", 1).alias("std6"))


@query("min_obs_span", f"SELECT series_id, count(value) AS n, round((max(period_date) - min(period_date)) / 365.25, 6) AS span_years FROM ({GAPPY}) GROUP BY 1 HAVING count(value) >= 36 AND (max(period_date) - min(period_date)) / 365.25 >= 5")
def min_obs_span(spark, sf):
    return ts.span(ts.long_enough(gappy(Tables(spark, sf)), 36, 5.0)).select("series_id", "n", r6("span_years"))


@query("constant_columns", "SELECT c_mktsegment || (c_nationkey % 2) AS series_id, count(*) AS n FROM (SELECT *, CASE WHEN c_nationkey % 2 = 0 THEN 1 ELSE c_acctbal END AS v FROM customer) GROUP BY 1 HAVING min(v) < max(v)")
def constant_columns(spark, sf):
    c = Tables(spark, sf).customer
    d = c.select(F.concat("c_mktsegment", (F.col("c_nationkey") % 2).cast("string")).alias("series_id"), F.when(F.col("c_nationkey") % 2 == 0, 1.0).otherwise(F.col("c_acctbal")).alias("value"))
    return ts.varying(d).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))


@query("almost_constant", f"SELECT series_id, count(value) AS n, count(value) < 10 OR coalesce(stddev_pop(value), 0) < 1e-12 AS constant FROM ({GAPPY}) GROUP BY 1")
def almost_constant(spark, sf):
    return ts.almost_constant(gappy(Tables(spark, sf)))


@query("long_to_wide", f"""SELECT period_date, {', '.join(f"round(max(CASE WHEN series_id = '{s}' THEN value END), 4) AS {s}" for s in ('AF', 'AO', 'NF', 'NO', 'RF', 'RO'))} FROM ({PANEL}) GROUP BY 1""")
def long_to_wide(spark, sf):
    ids = ["AF", "AO", "NF", "NO", "RF", "RO"]
    d = panel(Tables(spark, sf)).groupBy("period_date").pivot("series_id", ids).agg(F.max("value"))
    return d.select("period_date", *(F.round(i, 4).alias(i) for i in ids))


@query("calendar_union", f"""SELECT period_date, quarter_label, n FROM (SELECT period_date, CAST(year(period_date) AS VARCHAR) || 'Q' || quarter(period_date) AS quarter_label, count(*) AS n
  FROM (SELECT DISTINCT period_date, src FROM (SELECT period_date, 1 AS src FROM ({PANEL}) UNION ALL SELECT period_date, 2 FROM ({GAPPY}))) GROUP BY 1, 2)""")
def calendar_union(spark, sf):
    t = Tables(spark, sf)
    d = panel(t).select("period_date", F.lit(1).alias("src")).unionByName(gappy(t).select("period_date", F.lit(2).alias("src"))).distinct()
    return d.groupBy("period_date", quarter_label(F.col("period_date")).alias("quarter_label")).agg(F.count(F.lit(1)).alias("n"))
