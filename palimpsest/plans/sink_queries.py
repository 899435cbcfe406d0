"""Round trips through sinks, seasonality from metadata, validation summaries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from palimpsest.operators import timeseries as ts
from palimpsest.plans.base import GAPPY, GAPPY_DENSE, PANEL, Tables, gappy, panel, query
from palimpsest.sources import sinks


def _place(spark) -> str:
    return f"{sinks.scratch(spark)}/sink-{uuid.uuid4().hex}"


@query("partitioned_write", f"SELECT left(series_id, 1) AS provider, count(*) AS n, round(sum(value), 2) AS total FROM ({PANEL}) WHERE left(series_id, 1) IN ('A', 'R') GROUP BY 1")
def partitioned_write(spark, sf):
    at = _place(spark)
    sinks.write_long(panel(Tables(spark, sf)).withColumn("provider", F.substring("series_id", 1, 1)), at)
    d = spark.read.parquet(at).where(F.col("provider").isin("A", "R"))  # only these folders are read
    return d.groupBy("provider").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


_FLAGS = ["AF", "AO", "NF", "NO", "RF", "RO"]


@query("wide_write", f"SELECT count(DISTINCT period_date) AS n_rows, {', '.join(f"count(CASE WHEN series_id = '{x}' THEN 1 END) AS n_{x.lower()}" for x in _FLAGS)} FROM ({PANEL})")
def wide_write(spark, sf):
    at = _place(spark)
    sinks.write_wide(panel(Tables(spark, sf)), at, _FLAGS)
    return spark.read.parquet(at).agg(F.count(F.lit(1)).alias("n_rows"), *(F.count(x).alias(f"n_{x.lower()}") for x in _FLAGS))


@query("resumed_results", "SELECT p_brand, count(*) AS n FROM (SELECT DISTINCT p_brand, p_size FROM part) GROUP BY 1")
def resumed_results(spark, sf):
    at = _place(spark)
    p = Tables(spark, sf).part.select("p_brand", "p_size").distinct()
    sinks.append_results(p.where("p_size < 25"), at, ["p_brand", "p_size"])
    sinks.append_results(p, at, ["p_brand", "p_size"])
    return spark.read.parquet(at).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@query("decision_cache", f"SELECT series_id, n, n % 3 > 0 AND n <= 1.1 * (n - n % 3 * 3) AS reused FROM (SELECT series_id, count(*) AS n FROM ({GAPPY}) GROUP BY 1)")
def decision_cache(spark, sf):
    s = gappy(Tables(spark, sf)).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    cache = s.select("series_id", (F.col("n") - F.col("n") % 3 * 3).alias("n"), F.lit("log").alias("decision"), (F.col("n") % 3 > 0).alias("success"))
    old, new = sinks.reuse_cache(s, cache)
    return old.select("series_id", "n", F.lit(True).alias("reused")).unionByName(new.select("series_id", "n", F.lit(False).alias("reused")))


@query("panel_validation", f"SELECT count(*) AS n_rows, count(*) - count(value) AS n_missing, round(1 - count(value) / count(*), 6) AS missing_share, count(DISTINCT series_id) AS n_series, count(*) < 12 AS too_short FROM ({GAPPY_DENSE})")
def panel_validation(spark, sf):
    d = ts.dense(gappy(Tables(spark, sf)))
    return d.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("value").isNull()).alias("n_missing"), F.round(1 - F.count("value") / F.count(F.lit(1)), 6).alias("missing_share"),
        F.countDistinct("series_id").alias("n_series"), (F.count(F.lit(1)) < 12).alias("too_short"),
    )


@query("keyword_seasonality", "SELECT p_partkey, CASE WHEN regexp_matches(lower(p_type || ' ' || p_name), 'not seasonally adjusted|unadjusted|nsa|standard') THEN 'nsa' WHEN regexp_matches(lower(p_type || ' ' || p_name), 'seasonally adjusted|s_adj=sa|economy') THEN 'sa' ELSE 'unknown' END AS kind FROM part")
def keyword_seasonality(spark, sf):
    """The words for unadjusted data win, since they contain those for adjusted data."""
    text = F.lower(F.concat_ws(" ", "p_type", "p_name"))
    kind = F.when(text.rlike("not seasonally adjusted|unadjusted|nsa|standard"), "nsa").when(text.rlike("seasonally adjusted|s_adj=sa|economy"), "sa").otherwise("unknown")
    return Tables(spark, sf).part.select("p_partkey", kind.alias("kind"))


@query("drop_report", f"""SELECT reason, count(*) AS n FROM (SELECT series_id, CASE WHEN count(value) < 36 THEN 'min_obs' WHEN (max(period_date) - min(period_date)) / 365.25 < 6.4 THEN 'min_span' WHEN min(value) = max(value) THEN 'constant' ELSE 'kept' END AS reason FROM ({GAPPY}) GROUP BY 1) GROUP BY 1""")
def drop_report(spark, sf):
    d = gappy(Tables(spark, sf)).groupBy("series_id").agg(F.count("value").alias("n"), (F.datediff(F.max("period_date"), F.min("period_date")) / 365.25).alias("years"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    reason = F.when(F.col("n") < 36, "min_obs").when(F.col("years") < 6.4, "min_span").when(F.col("lo") == F.col("hi"), "constant").otherwise("kept")
    return d.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("prepared_panel", f"""WITH d AS ({GAPPY_DENSE}), i AS (
    SELECT *, CASE WHEN value IS NOT NULL THEN value WHEN nn - pn - 1 BETWEEN 1 AND 3 THEN pv + (nv - pv) * (n - pn) / (nn - pn) END AS filled FROM (
      SELECT *, last_value(value IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN value IS NOT NULL THEN n END IGNORE NULLS) OVER b AS pn, first_value(value IGNORE NULLS) OVER a AS nv, first_value(CASE WHEN value IS NOT NULL THEN n END IGNORE NULLS) OVER a AS nn
      FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY period_date) AS n FROM d)
      WINDOW b AS (PARTITION BY series_id ORDER BY period_date ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY series_id ORDER BY period_date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))),
  y AS (SELECT series_id, period_date, ln(filled) - lag(ln(filled), 12) OVER (PARTITION BY series_id ORDER BY period_date) AS z FROM i),
  q AS (SELECT series_id, quantile_cont(z, 0.01) AS lo, quantile_cont(z, 0.99) AS hi FROM y GROUP BY 1)
  SELECT series_id, period_date, round(greatest(least(z, hi), lo), 6) AS value FROM y JOIN q USING (series_id) WHERE z IS NOT NULL""")
def prepared_panel(spark, sf):
    """The preparation chain in one plan: dense calendar, gap imputation, year-on-year log difference, winsorising."""
    d = ts.impute_gaps(ts.dense(gappy(Tables(spark, sf)))).select("series_id", "period_date", F.col("filled").alias("value"))
    d = ts.seasonal_diff(d, 12, "z").select("series_id", "period_date", F.col("z").alias("value"))
    return ts.winsorize(d).where("clipped is not null").select("series_id", "period_date", F.round("clipped", 6).alias("value"))


_YEARS = "SELECT c_nationkey AS nation, year(CAST(o_orderdate AS DATE)) AS year, count(*) AS n, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"


@query("chunked_run", f"SELECT y.*, 25 AS first_run, 1 AS second_run FROM ({_YEARS}) y")
def chunked_run(spark, sf):
    """Orders by nation and year, a chunk for each nation; a broken file is moved aside, and a lost chunk alone runs again."""
    import uuid

    from palimpsest.sources import chunks

    t = Tables(spark, sf)
    root, schema = f"{sinks.scratch(spark)}/chunks-{uuid.uuid4().hex}", "nation int, year int, n long, total double"
    tasks = t.customer.select(F.col("c_nationkey").alias("chunk"), "c_custkey")

    def make(asked):
        d = t.orders.join(asked, F.col("o_custkey") == F.col("c_custkey"))
        amount = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
        return d.groupBy("chunk", F.col("chunk").cast("int").alias("nation"), F.year(F.col("o_orderdate").cast("date")).alias("year")).agg(F.count(F.lit(1)).alias("n"), amount.alias("total"))

    _, first = chunks.run(tasks, make, root, schema)
    spark.createDataFrame([("{broken",)], "value string").coalesce(1).write.mode("append").text(f"{root}/results/chunk=3")
    hadoop = spark._jvm.org.apache.hadoop.fs
    lost = hadoop.Path(f"{root}/results/chunk=7")
    lost.getFileSystem(spark._jsc.hadoopConfiguration()).delete(lost, True)
    out, second = chunks.run(tasks, make, root, schema)
    return out.select("*", F.lit(first).alias("first_run"), F.lit(second).alias("second_run"))
