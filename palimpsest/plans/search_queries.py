"""Searches over configurations, with parts standing in for configurations and their results."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import search as se
from palimpsest.plans.base import GAPPY, PANEL, TARGET, Tables, gappy, panel, query, target

RESULTS = "SELECT p_partkey AS config_id, p_brand AS model, CASE WHEN p_size % 3 = 0 THEN 'failed' ELSE 'success' END AS status, CASE WHEN p_size % 3 > 0 THEN p_retailprice END AS rmse FROM part"


def results(t: Tables):
    ok = F.col("p_size") % 3 > 0
    return t.part.select(F.col("p_partkey").alias("config_id"), F.col("p_brand").alias("model"), F.when(ok, "success").otherwise("failed").alias("status"), F.when(ok, F.col("p_retailprice")).alias("rmse"))


@query("staged_promotion", f"SELECT config_id, model, rmse FROM ({RESULTS}) WHERE status = 'success' AND rmse IS NOT NULL ORDER BY rmse, config_id LIMIT 20")
def staged_promotion(spark, sf):
    return se.promoted(results(Tables(spark, sf)), 20, status="status").select("config_id", "model", "rmse")


@query("success_first", f"SELECT config_id, status, rmse FROM ({RESULTS}) ORDER BY status <> 'success', rmse NULLS LAST, config_id")
def success_first(spark, sf):
    return se.success_first(results(Tables(spark, sf))).select("config_id", "status", "rmse")


@query("seeded_shuffle", "SELECT p_partkey AS config_id FROM part ORDER BY md5('7:' || CAST(p_partkey AS VARCHAR)), p_partkey LIMIT 40")
def seeded_shuffle(spark, sf):
    return se.shuffled(Tables(spark, sf).part.select(F.col("p_partkey").alias("config_id")), 7, 40)


@query("feasible_windows", f"""SELECT series_id, n, array_to_string(CASE WHEN len(list_filter([36, 60, 80], lambda w: w < n - 5)) > 0 THEN list_filter([36, 60, 80], lambda w: w < n - 5)
  WHEN n > 15 THEN list_sort(list_distinct([CAST(trunc(n * 0.3) AS INTEGER), CAST(trunc(n * 0.5) AS INTEGER), CAST(trunc(n * 0.7) AS INTEGER)])) ELSE [CAST(greatest(5, n - 6) AS INTEGER)] END, ',') AS windows
  FROM (SELECT series_id, count(*) AS n FROM ({GAPPY}) GROUP BY 1)""")
def feasible_windows(spark, sf):
    d = gappy(Tables(spark, sf)).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    return d.select("series_id", "n", F.array_join(se.feasible_windows(F.col("n"), [36, 60, 80]).cast("array<string>"), ",").alias("windows"))


def _gap(part: str) -> str:
    return f"(max(period_date) - min(period_date)) / greatest(count(DISTINCT period_date) - 1, 1) AS {part}, count(DISTINCT period_date) AS n_{part}"


@query("frequency_ratio", f"SELECT series_id, CASE WHEN n_high < 2 OR n_low < 2 THEN 3 ELSE CAST(greatest(1, round_even(low / high, 0)) AS INTEGER) END AS ratio FROM (SELECT series_id, {_gap('high')} FROM ({GAPPY}) GROUP BY 1), (SELECT {_gap('low')} FROM ({TARGET}))")
def frequency_ratio(spark, sf):
    t = Tables(spark, sf)
    return se.frequency_ratio(gappy(t), target(t))


@query("completeness_cap", f"""WITH d AS (SELECT series_id, count(value) / (SELECT count(DISTINCT period_date) FROM ({GAPPY})) AS completeness FROM ({GAPPY}) GROUP BY 1),
  o AS (SELECT *, row_number() OVER (ORDER BY completeness DESC, series_id) AS k FROM d WHERE completeness > 0.5 AND series_id <> '3/1-URGENT')
  SELECT series_id, round(completeness, 6) AS completeness FROM o WHERE k < (SELECT greatest(10, least(30, floor(greatest(count(DISTINCT period_date), 1) / 3))) FROM ({GAPPY}))
  UNION ALL SELECT series_id, round(completeness, 6) FROM d WHERE series_id = '3/1-URGENT'""")
def completeness_cap(spark, sf):
    return se.completeness_cap(gappy(Tables(spark, sf)), "3/1-URGENT").select("series_id", F.round("completeness", 6).alias("completeness"))


@query("config_values", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k') ELSE event_type END AS found FROM events""")
def config_values(spark, sf):
    text = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.col("event_type"))
    return Tables(spark, sf).events.select("event_id", se.parsed(text, "k").alias("found"))


@query("signed_resume", "SELECT p_partkey AS config_id FROM part WHERE p_size % 2 = 0")
def signed_resume(spark, sf):
    """Results of runs with two signatures; only those of the present run are resumed."""
    sign = F.when(F.col("p_size") % 2 == 0, F.lit(se.signature({"model": "dfm", "lags": 2}))).otherwise(F.lit(se.signature({"model": "dfm", "lags": 3})))
    d = Tables(spark, sf).part.select(F.col("p_partkey").alias("config_id"), sign.alias("run_signature"))
    return se.resumable(d, {"lags": 2, "model": "dfm"}).select("config_id")


KEYS = f"SELECT series_id, max(period_date) AS last_date, md5(concat_ws('|', 'panel', series_id, '3', CAST(max(period_date) AS VARCHAR), string_agg(CAST(CAST(value AS DECIMAL(38,6)) AS VARCHAR), ',' ORDER BY period_date))) AS cache_key FROM ({PANEL}) GROUP BY 1"


@query("forecast_cache", f"SELECT series_id, cache_key, left(series_id, 1) = 'A' AS cached FROM ({KEYS})")
def forecast_cache(spark, sf):
    """Forecasts are there for the series of A*; all others must be made anew."""
    keys = se.cache_keys(panel(Tables(spark, sf)), "panel", 3)
    cache = keys.where(F.col("series_id").startswith("A")).select("cache_key", "series_id", F.lit(0.0).alias("forecast"))
    old, new = se.from_cache(keys, cache)
    return old.select("series_id", "cache_key", F.lit(True).alias("cached")).unionByName(new.select("series_id", "cache_key", F.lit(False).alias("cached")))
