"""Vintages built and evaluated, mixed frequencies, factor models, preparation reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import backtests as bt
from palimpsest.operators import evaluation as ev
from palimpsest.operators import models as md
from palimpsest.operators import quality as qu
from palimpsest.operators import timeseries as ts
from palimpsest.operators import vintage as vt
from palimpsest.plans.base import GAPPY, GAPPY_DENSE, PANEL, QEND, REVISED, TARGET, Tables, gappy, panel, query, revised, target
from palimpsest.plans.vintage_queries import CUTS, MASKED, cuts, lagged_panel


@query("time_interpolation", f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY period_date) AS n FROM ({GAPPY_DENSE})), k AS (
    SELECT *, last_value(value IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN value IS NOT NULL THEN period_date END IGNORE NULLS) OVER b AS pd, last_value(CASE WHEN value IS NOT NULL THEN n END IGNORE NULLS) OVER b AS pn,
           first_value(value IGNORE NULLS) OVER a AS nv, first_value(CASE WHEN value IS NOT NULL THEN period_date END IGNORE NULLS) OVER a AS nd FROM n
    WINDOW b AS (PARTITION BY series_id ORDER BY period_date ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY series_id ORDER BY period_date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT series_id, period_date, round(CASE WHEN value IS NOT NULL THEN value WHEN n - pn <= 2 THEN pv + (nv - pv) * (period_date - pd) / (nd - pd) END, 4) AS filled FROM k""")
def time_interpolation(spark, sf):
    return ts.interpolate_by_time(ts.dense(gappy(Tables(spark, sf))), limit=2).select("series_id", "period_date", F.round("filled", 4).alias("filled"))


def built(t: Tables, fill: str = "locf", least_share: float = 0.0):
    y = target(t).where("y is not null").select("period_date", F.col("y").alias("value"))
    return vt.build(lagged_panel(t), y, cuts(t), fill, least_share)


@query("vintage_builder", f"""WITH m AS (SELECT * FROM ({MASKED}) WINDOW w AS (PARTITION BY target_quarter, label, series_id) QUALIFY count(value) OVER w / count(*) OVER w >= 0.9),
  f AS (SELECT target_quarter, label, series_id, period_date, last_value(value IGNORE NULLS) OVER (PARTITION BY target_quarter, label, series_id ORDER BY period_date ROWS UNBOUNDED PRECEDING) AS value FROM m),
  y AS (SELECT target_quarter, label, '__target' AS series_id, period_date, CASE WHEN period_date + 30 <= cutoff THEN y END AS value FROM (SELECT period_date, y FROM ({TARGET}) WHERE y IS NOT NULL) t JOIN ({CUTS}) c ON period_date <= cutoff AND period_date < target_quarter
        UNION ALL SELECT target_quarter, label, '__target', target_quarter, NULL FROM ({CUTS}))
  SELECT target_quarter, label, series_id, CASE WHEN period_date = target_quarter THEN 'test' ELSE 'train' END AS split, count(*) AS n, count(value) AS n_known, round(sum(value), 4) AS total FROM (SELECT * FROM f UNION ALL SELECT * FROM y) GROUP BY 1, 2, 3, 4""")
def vintage_builder(spark, sf):
    d = built(Tables(spark, sf), "locf", 0.9)
    return d.groupBy("target_quarter", "label", "series_id", "split").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_known"), F.round(F.sum("value"), 4).alias("total"))


@query("vintage_evaluation")
def vintage_evaluation(spark, sf):
    return md.evaluated(built(Tables(spark, sf)), "ridge", {"alpha": 1.0})


@query("arima_vintages")
def arima_vintages(spark, sf):
    """Each vintage's series with the months that were not published yet forecast from those that were."""
    d = built(Tables(spark, sf), "arima", 0.5)
    return d.groupBy("target_quarter", "label", "series_id", "split").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_known"), F.round(F.sum("value"), 4).alias("total"))


@query("mixed_frequency_load", f"""SELECT period_date, round(value, 4) AS value, 'y' AS part FROM (SELECT {QEND.format(d='period_date')} AS period_date, arg_max(value, period_date) AS value FROM ({PANEL}) WHERE series_id = 'AF' GROUP BY 1)
  UNION ALL SELECT period_date, round(sum(value), 4), 'monthly' FROM ({PANEL}) WHERE series_id <> 'AF' GROUP BY 1""")
def mixed_frequency_load(spark, sf):
    monthly, _, y = vt.mixed_frequency(panel(Tables(spark, sf)), None, "AF")
    whole = monthly.groupBy("period_date").agg(F.sum("value").alias("value"))
    part = lambda d, name: d.select("period_date", F.round("value", 4).alias("value"), F.lit(name).alias("part"))
    return part(y, "y").unionByName(part(whole, "monthly"))


@query("umidas_design", f"""SELECT series_id || '@' || CAST(k AS VARCHAR) AS series_id, period_date, round(v, 4) AS value FROM (
  SELECT series_id, period_date, unnest(range(6)) AS k, unnest([value, lag(value, 1) OVER w, lag(value, 2) OVER w, lag(value, 3) OVER w, lag(value, 4) OVER w, lag(value, 5) OVER w]) AS v
  FROM ({GAPPY_DENSE}) WINDOW w AS (PARTITION BY series_id ORDER BY period_date)) WHERE month(period_date) % 3 = 0""")
def umidas_design(spark, sf):
    return vt.umidas(ts.dense(gappy(Tables(spark, sf)))).select("series_id", "period_date", F.round("value", 4).alias("value"))


def _growth(t: Tables):
    return ts.seasonal_diff(panel(t), 12, "g").select("series_id", "period_date", F.col("g").alias("value"))


@query("umidas_backtest")
def umidas_backtest(spark, sf):
    t = Tables(spark, sf)
    y = target(t).where("y is not null")
    return bt.backtest(vt.umidas(_growth(t)).where("value is not null"), y, ev.folds(y, 10, 1), "ridge", {"alpha": 1.0})


@query("dfm_nowcast")
def dfm_nowcast(spark, sf):
    """Expanding-window nowcasts of the dynamic factor model."""
    t = Tables(spark, sf)
    y = target(t).where("y is not null")
    return bt.backtest(_growth(t).where("value is not null"), y, ev.folds(y, 10, 1), "dynamic_factor", {"factors": 1, "order": 1})


@query("dfm_vintages")
def dfm_vintages(spark, sf):
    return md.evaluated(built(Tables(spark, sf), "none"), "dynamic_factor", {"factors": 1, "order": 1})


_PREPARED = f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY period_date) AS n FROM ({GAPPY_DENSE})), k AS (
    SELECT *, last_value(value IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN value IS NOT NULL THEN n END IGNORE NULLS) OVER b AS pn,
           first_value(value IGNORE NULLS) OVER a AS nv, first_value(CASE WHEN value IS NOT NULL THEN n END IGNORE NULLS) OVER a AS nn FROM n
    WINDOW b AS (PARTITION BY series_id ORDER BY period_date ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY series_id ORDER BY period_date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
  ), i AS (SELECT series_id, period_date, value, nn - pn - 1 AS run, CASE WHEN value IS NOT NULL THEN value WHEN nn - pn - 1 BETWEEN 1 AND 3 THEN pv + (nv - pv) * (n - pn) / (nn - pn) END AS filled FROM k),
  look AS (SELECT series_id, coalesce(max(CASE WHEN value IS NOT NULL THEN period_date END) - min(CASE WHEN value IS NOT NULL THEN period_date END), 0) / 365.25 AS span_years, count(value) AS initial_non_nan,
      CAST(count_if(value IS NULL AND filled IS NOT NULL AND run = 1) AS BIGINT) AS gaps_avg_1, CAST(count_if(value IS NULL AND filled IS NOT NULL AND run > 1) AS BIGINT) AS gaps_linear_23 FROM i GROUP BY 1),
  c AS (SELECT series_id, period_date, e - avg(e) OVER (PARTITION BY series_id) AS c FROM (SELECT series_id, period_date, filled - lag(filled) OVER (PARTITION BY series_id ORDER BY period_date) AS e FROM i WHERE filled IS NOT NULL) WHERE e IS NOT NULL),
  acf AS (SELECT series_id, count(c) AS n, sum(c * l) / sum(c * c) AS acf FROM (SELECT *, lag(c, 12) OVER (PARTITION BY series_id ORDER BY period_date) AS l FROM c) GROUP BY 1),
  seas AS (SELECT look.*, CASE WHEN span_years < 5 THEN 'too_short_span' WHEN initial_non_nan < 36 THEN 'too_few_obs_initial' END AS dropped_reason, coalesce(n + 1 > 24 AND n > 12 AND acf > 0.2, false) AS is_seasonal FROM look LEFT JOIN acf USING (series_id)),
  z AS (SELECT series_id, CASE WHEN is_seasonal THEN v - lag(v, 12) OVER w ELSE v - lag(v) OVER w END AS z FROM (
      SELECT series_id, period_date, is_seasonal, CASE WHEN min(filled) OVER (PARTITION BY series_id) > 0 THEN ln(filled) ELSE filled END AS v FROM i JOIN seas USING (series_id) WHERE dropped_reason IS NULL) WINDOW w AS (PARTITION BY series_id ORDER BY period_date))
  SELECT series_id, round(span_years, 6) AS span_years, initial_non_nan, gaps_avg_1, gaps_linear_23, dropped_reason, CASE WHEN dropped_reason IS NULL THEN is_seasonal END AS is_seasonal, n_z, total FROM seas
  LEFT JOIN (SELECT series_id, count(z) AS n_z, round(sum(z), 6) AS total FROM z GROUP BY 1) USING (series_id)"""


@query("preparation_stages", _PREPARED)
def preparation_stages(spark, sf):
    """All of preparation but the stationarity test: calendar, gaps, first checks, seasonality, base transformation."""
    from palimpsest.operators import preparation as pr
    from palimpsest.sources.sinks import stored

    dense = stored(pr.regular(gappy(Tables(spark, sf))))
    look = pr.first_look(dense, 36, 5.0)
    going = dense.join(look.where("dropped_reason is null").select("series_id"), "series_id", "left_semi")
    found = pr.seasonality(going)
    z = pr.base_transformed(going, found).groupBy("series_id").agg(F.count("z").alias("n_z"), F.round(F.sum("z"), 6).alias("total"))
    d = look.join(found.select("series_id", "is_seasonal"), "series_id", "left").join(z, "series_id", "left")
    return d.select("series_id", F.round("span_years", 6).alias("span_years"), "initial_non_nan", "gaps_avg_1", "gaps_linear_23", "dropped_reason", "is_seasonal", "n_z", "total")


@query("preparation_report")
def preparation_report(spark, sf):
    from palimpsest.operators import preparation as pr

    return pr.prepared(gappy(Tables(spark, sf)), least=36, least_years=5.0)[0]


@query("mixed_preparation_report")
def mixed_preparation_report(spark, sf):
    """The options of mixed-frequency preparation: one further difference, no cutting, nonstationary series stay."""
    from palimpsest.operators import preparation as pr

    return pr.prepared(gappy(Tables(spark, sf)), mixed=True, least=36, least_years=5.0, ragged_limit=4)[0]


@query("search_streams", f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY period_date) AS n FROM ({GAPPY_DENSE})), k AS (
    SELECT *, last_value(value IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN value IS NOT NULL THEN n END IGNORE NULLS) OVER b AS pn,
           first_value(value IGNORE NULLS) OVER a AS nv, first_value(CASE WHEN value IS NOT NULL THEN n END IGNORE NULLS) OVER a AS nn FROM n
    WINDOW b AS (PARTITION BY series_id ORDER BY period_date ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY series_id ORDER BY period_date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
  ), i AS (SELECT series_id, period_date, count(value) OVER (PARTITION BY series_id) AS known, CASE WHEN value IS NOT NULL THEN value WHEN nn - pn - 1 BETWEEN 1 AND 3 THEN pv + (nv - pv) * (n - pn) / (nn - pn) END AS filled FROM k),
  z AS (SELECT series_id, period_date, filled - lag(filled, 12) OVER (PARTITION BY series_id ORDER BY period_date) AS z FROM i WHERE known >= 36),
  q AS (SELECT series_id, quantile_cont(z, 0.01) AS lo, quantile_cont(z, 0.99) AS hi, count(z) AS m FROM z GROUP BY 1)
  SELECT 'gt_' || series_id AS series_id, count(*) AS n, round(sum(greatest(least(z, hi), lo)), 2) AS total FROM z JOIN q USING (series_id) WHERE z IS NOT NULL AND m >= 36 GROUP BY 1""")
def search_streams(spark, sf):
    from palimpsest.operators import preparation as pr

    d = gappy(Tables(spark, sf)).withColumn("series_id", F.concat(F.lit("gt_"), "series_id"))
    return pr.search_prepared(d, "yoy", 36, 1.0).groupBy("series_id").agg(F.count("value").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("frequency_assembly")
def frequency_assembly(spark, sf):
    """Monthly, quarterly and search streams under one frequency map: rows and dates of each."""
    from palimpsest.operators import preparation as pr

    t = Tables(spark, sf)
    quarterly = gappy(t).where(F.col("series_id").endswith("1-URGENT"))
    whole, frequencies, y = pr.assembled(panel(t), quarterly, gappy(t).where(F.col("series_id").endswith("5-LOW")), "3/1-URGENT", least=16, least_years=4.0)
    d = whole.join(frequencies, ["series_id", "frequency"], "left_semi").unionByName(y.select(F.lit("y").alias("series_id"), F.lit("target").alias("frequency"), "period_date", F.col("y").alias("value")))
    return d.groupBy("frequency", "series_id").agg(F.count("value").alias("n"), F.min("period_date").alias("first"), F.max("period_date").alias("last"))


@query("input_problems", f"""SELECT series_id, CASE WHEN count(value) = 0 THEN 'all_null' WHEN count(CASE WHEN value IS NOT NULL AND known THEN 1 END) = 0 THEN 'no_overlap' END AS problem
  FROM (SELECT series_id, CASE WHEN series_id LIKE '1/%' THEN NULL ELSE value END AS value, y IS NOT NULL AS known FROM ({GAPPY}) LEFT JOIN (SELECT period_date, y FROM ({TARGET}) WHERE y IS NOT NULL) USING (period_date)) GROUP BY 1""")
def input_problems(spark, sf):
    t = Tables(spark, sf)
    d = gappy(t).withColumn("value", F.when(~F.col("series_id").startswith("1/"), F.col("value")))
    return qu.input_problems(d, target(t).where("y is not null").select("period_date"))


@query("recent_vintages", f"SELECT series_id, period_date, value, vintage FROM (SELECT series_id, period_date, value, CAST(observed_at AS DATE) AS vintage, dense_rank() OVER (PARTITION BY series_id ORDER BY CAST(observed_at AS DATE) DESC) AS k, row_number() OVER (PARTITION BY series_id, period_date, CAST(observed_at AS DATE) ORDER BY observed_at DESC, event_id DESC) AS r FROM ({REVISED})) WHERE k <= 3 AND r = 1")
def recent_vintages(spark, sf):
    """Each user's last three days of observation, and what was known of each period at the end of each."""
    from palimpsest.operators.bitemporal import recent_vintages as recent

    d = revised(Tables(spark, sf)).withColumn("vintage", F.col("observed_at").cast("date"))
    return recent(d, 3, tie="event_id").select("series_id", "period_date", "value", "vintage")


@query("update_starts", f"SELECT s.c_custkey AS series_id, coalesce(CAST(max(o.d) + 1 AS DATE), DATE '1995-01-01') AS start, max(o.d) IS NULL AS initial FROM customer s LEFT JOIN (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders) o ON o_custkey = c_custkey GROUP BY 1")
def update_starts(spark, sf):
    """Where each series' next download begins: after its last stored date, or at the first date for a new one."""
    from palimpsest.operators.bitemporal import update_starts as starts

    t = Tables(spark, sf)
    stored = t.orders.select(F.col("o_custkey").alias("series_id"), F.col("o_orderdate").cast("date").alias("period_date"))
    return starts(t.customer.select(F.col("c_custkey").alias("series_id")), stored, "1995-01-01")


@query("chunk_consolidation", f"SELECT series_id, count(*) AS n, round(sum(value), 2) AS total FROM ({GAPPY}) GROUP BY 1")
def chunk_consolidation(spark, sf):
    """Wide chunk files, a few series in each, put together again in long form."""
    import uuid

    from palimpsest.sources import sinks
    from palimpsest.sources.files import consolidated

    root = f"{sinks.scratch(spark)}/chunks-{uuid.uuid4().hex}"
    d = gappy(Tables(spark, sf))
    names = sorted(r[0] for r in d.select("series_id").distinct().collect())  # the columns of wide files, as many as the files can have
    for k in range(0, len(names), 50):
        sinks.write_wide(d, f"{root}/part{k // 50}", names[k : k + 50])
    out = consolidated(spark, [f"{root}/part{k // 50}" for k in range(0, len(names), 50)])
    return out.groupBy("series_id").agg(F.count("value").alias("n"), F.round(F.sum("value"), 2).alias("total")).where("n > 0")


_KEYS = f"SELECT count(*) FROM (SELECT DISTINCT series_id, period_date, observed_at FROM ({REVISED}))"


@query("flow_ingest", f"SELECT run, status, rows_inserted, n FROM (VALUES (0, 'ok'), (1, 'skipped'), (2, 'ok'), (3, 'ok')) r(run, status), (SELECT ({_KEYS}) AS n), LATERAL (SELECT CASE WHEN run = 0 THEN n ELSE 0 END AS rows_inserted)")
def flow_ingest(spark, sf):
    """One flow four times: all of it, the same again, with values gone, and as at first: only a scope's last release counts."""
    import uuid

    from palimpsest.sources import sinks
    from palimpsest.streaming.ingest import ingest_flow

    root = f"{sinks.scratch(spark)}/flow-{uuid.uuid4().hex}"
    rows = revised(Tables(spark, sf)).select("series_id", "period_date", "observed_at", "value", "event_id")
    gone = rows.withColumn("value", F.when(F.col("event_id") % 2 == 0, F.col("value")))
    logs = [ingest_flow(d, root, ["series_id", "period_date", "observed_at"], tie="event_id", scope="events") for d in (rows, rows, gone, rows)]
    n = spark.read.parquet(f"{root}/observations").count()
    return spark.createDataFrame([(k, x["status"], x["rows_inserted"], n) for k, x in enumerate(logs)], "run int, status string, rows_inserted long, n long")
