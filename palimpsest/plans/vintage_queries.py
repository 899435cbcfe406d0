"""Vintage, screening, evaluation and configuration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import periods as pf
from palimpsest.operators import evaluation as ev
from palimpsest.operators import screening as sc
from palimpsest.operators import timeseries as ts
from palimpsest.operators import vintage as vt
from palimpsest.operators.sizes import broadcast_if_small
from palimpsest.plans.base import FORECASTS, GAPPY, GAPPY_DENSE, PANEL, QEND, TARGET, Tables, forecasts, gappy, panel, query, target

CUTS = f"SELECT period_date AS target_quarter, label, last_day(CAST(period_date + to_months(CAST(label AS INTEGER)) AS DATE)) AS cutoff FROM (SELECT period_date FROM ({TARGET})), (SELECT unnest([-2, -1, 0, 1, 2]) AS label)"


def cuts(t: Tables):
    q = target(t).select(F.col("period_date").alias("target_quarter"))
    return vt.cutoffs(q)


def lagged_panel(t: Tables):
    """The panel with each series' frequency and release lag: A* are quarterly, N* search interest, R* macro."""
    f = F.when(F.col("series_id").startswith("A"), "Q").when(F.col("series_id").startswith("N"), "GT").otherwise("M")
    return panel(t).withColumn("lag", vt.release_lag(F.col("series_id"), f, macro=1, quarterly=2, search=0))


LAGGED = f"SELECT *, CASE left(series_id, 1) WHEN 'A' THEN 2 WHEN 'N' THEN 0 ELSE 1 END AS lag FROM ({PANEL})"
MASKED = f"SELECT series_id, period_date, target_quarter, label, cutoff, CASE WHEN lag <= 0 OR period_date <= last_day(CAST(cutoff - to_months(lag) AS DATE)) THEN value END AS value FROM ({LAGGED}) p JOIN ({CUTS}) c ON p.period_date <= c.cutoff"


@query("vintage_cutoffs", CUTS)
def vintage_cutoffs(spark, sf):
    return cuts(Tables(spark, sf))


@query("visibility_mask", f"SELECT target_quarter, label, series_id, count(*) AS n, count(value) AS n_visible, max(CASE WHEN value IS NOT NULL THEN period_date END) AS last_visible FROM ({MASKED}) GROUP BY 1, 2, 3")
def visibility_mask(spark, sf):
    t = Tables(spark, sf)
    m = vt.visible(lagged_panel(t), cuts(t))
    return m.groupBy("target_quarter", "label", "series_id").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_visible"), F.max(F.when(F.col("value").isNotNull(), F.col("period_date"))).alias("last_visible"))


@query("vintage_counts", f"SELECT target_quarter, label, count(*) AS n_cells, count(*) - count(value) AS n_missing, count(DISTINCT CASE WHEN value IS NOT NULL THEN series_id END) AS n_series FROM ({MASKED}) GROUP BY 1, 2")
def vintage_counts(spark, sf):
    t = Tables(spark, sf)
    m = vt.visible(lagged_panel(t), cuts(t))
    return m.groupBy("target_quarter", "label").agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col("value").isNull()).alias("n_missing"), F.countDistinct(F.when(F.col("value").isNotNull(), F.col("series_id"))).alias("n_series"))


SEEN = f"SELECT t.period_date, target_quarter, label, CASE WHEN t.period_date + 30 <= cutoff THEN y END AS value FROM ({TARGET}) t JOIN ({CUTS}) c ON t.period_date <= c.cutoff"


def seen(t: Tables):
    return vt.visible_target(target(t).select("period_date", F.col("y").alias("value")), cuts(t))


@query("rolling_target_window", f"SELECT target_quarter, label, period_date, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY target_quarter, label ORDER BY period_date DESC) AS k FROM ({SEEN}) WHERE value IS NOT NULL) WHERE k <= 5")
def rolling_target_window(spark, sf):
    d = vt.last_targets(seen(Tables(spark, sf)), 5)
    return d.select("target_quarter", "label", "period_date", F.round("value", 6).alias("value"))


@query("train_test_split", f"SELECT target_quarter, label, count(CASE WHEN period_date < target_quarter AND value IS NOT NULL THEN 1 END) AS n_train, count(CASE WHEN period_date = target_quarter THEN 1 END) AS n_test, count(CASE WHEN period_date = target_quarter AND value IS NOT NULL THEN 1 END) AS n_test_known FROM ({SEEN}) GROUP BY 1, 2")
def train_test_split(spark, sf):
    at, known = F.col("period_date") == F.col("target_quarter"), F.col("value").isNotNull()
    return seen(Tables(spark, sf)).groupBy("target_quarter", "label").agg(
        F.count_if((F.col("period_date") < F.col("target_quarter")) & known).alias("n_train"), F.count_if(at).alias("n_test"), F.count_if(at & known).alias("n_test_known"))


@query("publication_cutoff", f"SELECT series_id, count(*) AS n, max(period_date) AS last FROM (SELECT *, CASE WHEN series_id LIKE 'A%' THEN 'QE' WHEN series_id LIKE 'N%' THEN 'monthly' ELSE 'D' END AS frequency FROM ({PANEL})) WHERE period_date <= DATE '2000-06-15' - CASE WHEN upper(frequency) LIKE '%Q%' THEN 60 WHEN upper(frequency) LIKE '%M%' THEN 30 ELSE 0 END GROUP BY 1")
def publication_cutoff(spark, sf):
    f = F.when(F.col("series_id").startswith("A"), "QE").when(F.col("series_id").startswith("N"), "monthly").otherwise("D")
    d = vt.publication_filter(panel(Tables(spark, sf)).withColumn("frequency", f), F.lit("2000-06-15").cast("date"))
    return d.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.max("period_date").alias("last"))


@query("calendar_blocks", f"SELECT series_id, {QEND.format(d='period_date')} AS quarter, round(max(CASE WHEN (month(period_date) - 1) % 3 = 0 THEN value END), 4) AS m1, round(max(CASE WHEN (month(period_date) - 1) % 3 = 1 THEN value END), 4) AS m2, round(max(CASE WHEN (month(period_date) - 1) % 3 = 2 THEN value END), 4) AS m3 FROM ({GAPPY}) GROUP BY 1, 2")
def calendar_blocks(spark, sf):
    return vt.calendar_blocks(gappy(Tables(spark, sf))).select("series_id", "quarter", *(F.round(f"m{k}", 4).alias(f"m{k}") for k in (1, 2, 3)))


@query("most_recent_lags", f"""WITH d AS ({GAPPY_DENSE}), q AS (SELECT series_id, period_date AS quarter FROM d WHERE month(period_date) % 3 = 0),
  r AS (SELECT q.series_id, quarter, value, row_number() OVER (PARTITION BY q.series_id, quarter ORDER BY d.period_date DESC) AS k FROM q JOIN d ON d.series_id = q.series_id AND d.period_date <= quarter AND d.value IS NOT NULL)
  SELECT q.series_id, q.quarter, round(max(CASE WHEN k = 1 THEN value END), 4) AS lag0, round(max(CASE WHEN k = 2 THEN value END), 4) AS lag1, round(max(CASE WHEN k = 3 THEN value END), 4) AS lag2 FROM q LEFT JOIN r ON r.series_id = q.series_id AND r.quarter = q.quarter AND k <= 3 GROUP BY 1, 2""")
def most_recent_lags(spark, sf):
    d = vt.most_recent(ts.dense(gappy(Tables(spark, sf))))
    return d.select("series_id", "quarter", *(F.round(f"lag{k}", 4).alias(f"lag{k}") for k in range(3)))


@query("midas_stack", f"SELECT series_id, period_date, round(lag(value, 3) OVER w, 4) AS t3, round(lag(value, 2) OVER w, 4) AS t2, round(lag(value, 1) OVER w, 4) AS t1, round(value, 4) AS t0 FROM ({GAPPY_DENSE}) WINDOW w AS (PARTITION BY series_id ORDER BY period_date)")
def midas_stack(spark, sf):
    d = vt.stacked(ts.dense(gappy(Tables(spark, sf))), 4)
    return d.select("series_id", "period_date", *(F.round(F.col("stack")[3 - k], 4).alias(f"t{k}") for k in (3, 2, 1, 0)))


@query("locf_fill", f"SELECT target_quarter, label, series_id, period_date, round(last_value(value IGNORE NULLS) OVER (PARTITION BY target_quarter, label, series_id ORDER BY period_date ROWS UNBOUNDED PRECEDING), 4) AS filled FROM ({MASKED})")
def locf_fill(spark, sf):
    t = Tables(spark, sf)
    m = vt.visible(lagged_panel(t), cuts(t))
    return vt.locf(m, ["target_quarter", "label", "series_id"]).select("target_quarter", "label", "series_id", "period_date", F.round("filled", 4).alias("filled"))


@query("rolling_mean_fill", f"SELECT series_id, round(arg_max(value, period_date), 4) AS last_value, round(avg(value), 4) AS recent_mean FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY period_date DESC) AS k FROM ({GAPPY})) WHERE k <= 12 GROUP BY 1")
def rolling_mean_fill(spark, sf):
    return vt.recent_mean(gappy(Tables(spark, sf))).select("series_id", F.round("last_value", 4).alias("last_value"), F.round("recent_mean", 4).alias("recent_mean"))


GROWTH = f"SELECT series_id, period_date, value FROM (SELECT series_id, period_date, ln(value) - lag(ln(value), 1) OVER (PARTITION BY series_id ORDER BY period_date) AS value FROM ({GAPPY_DENSE}))"


def growth(t: Tables):
    return ts.seasonal_diff(ts.dense(gappy(t)), 1, "g").select("series_id", "period_date", F.col("g").alias("value"))


CORR = "covar_samp({x}, {y}) / nullif(stddev_samp({x}) * stddev_samp({y}), 0)"


@query("corr_topn", f"SELECT series_id, n, round(CASE WHEN n > 5 THEN coalesce(c, 0) ELSE 0 END, 6) AS corr FROM (SELECT series_id, count(value) AS n, {CORR.format(x='CASE WHEN y IS NOT NULL THEN value END', y='CASE WHEN value IS NOT NULL THEN y END')} AS c FROM ({GROWTH}) JOIN (SELECT period_date, y FROM ({TARGET}) WHERE y IS NOT NULL) USING (period_date) GROUP BY 1) ORDER BY abs(CASE WHEN n > 5 THEN coalesce(c, 0) ELSE 0 END) DESC, series_id LIMIT 10")
def corr_topn(spark, sf):
    t = Tables(spark, sf)
    d = sc.target_scores(growth(t), target(t).where("y is not null"))
    return sc.top_n(d, 10).select("series_id", "n", F.round("corr", 6).alias("corr"))


def _lagcorr() -> str:
    cs = ", ".join(f"CASE WHEN count(CASE WHEN value IS NOT NULL AND y{k} IS NOT NULL THEN 1 END) >= 6 THEN abs(covar_samp(CASE WHEN y{k} IS NOT NULL THEN value END, CASE WHEN value IS NOT NULL THEN y{k} END) / nullif(stddev_samp(CASE WHEN y{k} IS NOT NULL THEN value END) * stddev_samp(CASE WHEN value IS NOT NULL THEN y{k} END), 0)) END" for k in range(4))
    ys = ", ".join(f"lag(y, {k}) OVER (ORDER BY period_date) AS y{k}" for k in range(4))
    return f"SELECT series_id, round(greatest({cs}), 6) AS best FROM ({GROWTH}) JOIN (SELECT period_date, {ys} FROM ({TARGET})) USING (period_date) GROUP BY 1"


@query("lag_corr_screen", _lagcorr())
def lag_corr_screen(spark, sf):
    t = Tables(spark, sf)
    return sc.lagged_correlations(growth(t), target(t)).select("series_id", F.round("best", 6).alias("best"))


@query("completeness_variance", f"SELECT series_id, round(count(value) / count(*), 6) AS completeness, round(var_samp(value), 6) AS variance FROM ({GROWTH}) GROUP BY 1")
def completeness_variance(spark, sf):
    return sc.screened(growth(Tables(spark, sf))).select("series_id", F.round("completeness", 6).alias("completeness"), F.round("variance", 6).alias("variance"))


@query("variance_filter", f"SELECT series_id, round(var_pop(coalesce(value, m)), 6) AS variance FROM (SELECT *, median(value) OVER (PARTITION BY series_id) AS m FROM ({GROWTH})) GROUP BY 1 HAVING var_pop(coalesce(value, m)) > 1e-6")
def variance_filter(spark, sf):
    return sc.median_filled_variance(growth(Tables(spark, sf))).where("variance > 1e-6").select("series_id", F.round("variance", 6).alias("variance"))


@query("window_scaler", f"SELECT series_id, period_date, CASE WHEN value IS NOT NULL THEN round((value - avg(coalesce(value, m)) OVER p) / nullif(stddev_pop(coalesce(value, m)) OVER p, 0), 6) END AS scaled FROM (SELECT *, median(value) OVER (PARTITION BY series_id) AS m FROM ({GROWTH})) WINDOW p AS (PARTITION BY series_id)")
def window_scaler(spark, sf):
    return sc.scaled(growth(Tables(spark, sf))).select("series_id", "period_date", F.round("scaled", 6).alias("scaled"))


FOLD = """WITH d AS (SELECT period_date, row_number() OVER (ORDER BY period_date) AS n FROM (SELECT DISTINCT period_date FROM ({t}))), f AS (SELECT unnest(generate_series(CAST({first} AS BIGINT), (SELECT max(n) FROM d) - 1, {step})) AS e)
  SELECT CAST((e - {first}) / {step} AS INTEGER) AS fold, a.period_date AS train_start, b.period_date AS train_end, c.period_date AS test_end FROM f JOIN d a ON a.n = {lo} JOIN d b ON b.n = e JOIN d c ON c.n = least(e + {step}, (SELECT max(n) FROM d))"""


@query("folds_expanding", FOLD.format(t=PANEL, first=30, step=3, lo="1"))
def folds_expanding(spark, sf):
    return ev.folds(panel(Tables(spark, sf)), 30, 3)


@query("folds_rolling", FOLD.format(t=f"SELECT period_date FROM ({TARGET}) WHERE y IS NOT NULL", first=8, step=1, lo="greatest(1, e - 8 + 1)"))
def folds_rolling(spark, sf):
    return ev.folds(target(Tables(spark, sf)).where("y is not null"), 8, 1, 8)


@query("fold_slices", f"""SELECT f.fold, series_id, count(CASE WHEN p.period_date <= train_end THEN 1 END) AS n_train, count(CASE WHEN p.period_date > train_end THEN 1 END) AS n_test
  FROM ({FOLD.format(t=PANEL, first=30, step=3, lo="1")}) f JOIN ({PANEL}) p ON p.period_date BETWEEN train_start AND test_end GROUP BY 1, 2""")
def fold_slices(spark, sf):
    p = panel(Tables(spark, sf))
    f = broadcast_if_small(ev.folds(p, 30, 3))
    d = p.join(f, F.col("period_date").between(F.col("train_start"), F.col("test_end")))
    return d.groupBy("fold", "series_id").agg(F.count_if(F.col("period_date") <= F.col("train_end")).alias("n_train"), F.count_if(F.col("period_date") > F.col("train_end")).alias("n_test"))


MET = "count(CASE WHEN actual IS NOT NULL AND predicted IS NOT NULL THEN 1 END) AS n_obs, round(sqrt(avg((actual - predicted) ^ 2)), 2) AS rmse, round(avg(abs(actual - predicted)), 2) AS mae, round(100 * avg(abs((actual - predicted) / CASE WHEN actual = 0 THEN 1e-8 ELSE actual END)), 6) AS mape"
def rounded():
    return [F.round("rmse", 2).alias("rmse"), F.round("mae", 2).alias("mae"), F.round("mape", 6).alias("mape")]



@query("metrics_overall", f"SELECT model, {MET} FROM ({FORECASTS}) GROUP BY 1")
def metrics_overall(spark, sf):
    return ev.metrics(forecasts(Tables(spark, sf)), ["model"]).select("model", "n_obs", *rounded())


@query("metrics_grouping_sets", f"SELECT model, CASE WHEN grouping(label) = 1 THEN 'overall' ELSE label END AS label, {MET} FROM (SELECT * REPLACE (CAST(label AS VARCHAR) AS label) FROM ({FORECASTS})) GROUP BY GROUPING SETS ((model, label), (model))")
def metrics_grouping_sets(spark, sf):
    return ev.metrics_with_overall(forecasts(Tables(spark, sf)), ["model"], "label").select("model", "label", "n_obs", *rounded())


@query("revisions", f"""SELECT model, CASE WHEN grouping(transition) = 1 THEN 'overall' ELSE transition END AS transition, round(avg(d), 2) AS avg_revision, count(d) AS n_revision_pairs FROM (
  SELECT model, lag(CAST(label AS VARCHAR)) OVER w || ' -> ' || label AS transition, abs(predicted - lag(predicted) OVER w) AS d FROM ({FORECASTS}) WINDOW w AS (PARTITION BY model, target_quarter ORDER BY label)) WHERE d IS NOT NULL GROUP BY GROUPING SETS ((model, transition), (model))""")
def revisions(spark, sf):
    d = ev.revisions(forecasts(Tables(spark, sf)), ["model"], "target_quarter", "label")
    return d.select("model", "transition", F.round("avg_revision", 2).alias("avg_revision"), "n_revision_pairs")


@query("running_rmse", f"SELECT model, label, target_quarter, round(sqrt(avg((actual - predicted) ^ 2) OVER (PARTITION BY model, label ORDER BY target_quarter ROWS UNBOUNDED PRECEDING)), 2) AS running_rmse FROM ({FORECASTS})")
def running_rmse(spark, sf):
    d = ev.running_rmse(forecasts(Tables(spark, sf)), ["model", "label"], "target_quarter")
    return d.select("model", "label", "target_quarter", F.round("running_rmse", 2).alias("running_rmse"))


@query("leaderboard", f"SELECT model, label, round(rmse, 2) AS rmse, rank FROM (SELECT *, row_number() OVER (ORDER BY rmse, model) AS rank FROM (SELECT DISTINCT ON (model) model, label, rmse FROM (SELECT model, label, sqrt(avg((actual - predicted) ^ 2)) AS rmse FROM ({FORECASTS}) GROUP BY 1, 2) ORDER BY model, rmse, label)) WHERE rank <= 3")
def leaderboard(spark, sf):
    from pyspark.sql import Window as W

    scores = ev.metrics(forecasts(Tables(spark, sf)), ["model", "label"])
    best = ev.best_rows(scores, ["model"], tie="label").orderBy("rmse", "model").limit(3)
    return best.withColumn("rank", F.row_number().over(W.orderBy("rmse", "model")).cast("long")).select("model", F.col("label").cast("long").alias("label"), F.round("rmse", 2).alias("rmse"), "rank")


@query("fold_feature_medians", f"SELECT label, median(n) AS median_n, count(DISTINCT model) AS n_models FROM (SELECT label, model, count(*) AS n FROM ({FORECASTS}) GROUP BY 1, 2) GROUP BY 1")
def fold_feature_medians(spark, sf):
    d = forecasts(Tables(spark, sf)).groupBy("label", "model").agg(F.count(F.lit(1)).alias("n"))
    return d.groupBy(F.col("label").cast("long").alias("label")).agg(F.median("n").alias("median_n"), F.countDistinct("model").alias("n_models"))


@query("prediction_extract", f"""SELECT model, label, target_date, predicted, CASE m WHEN 1 THEN 'exact' WHEN 2 THEN 'same_quarter' WHEN 3 THEN 'same_month' ELSE 'last' END AS mode FROM (
  SELECT DISTINCT ON (model, label, target_date) model, label, target_date, predicted, m FROM (
    SELECT f.model, f.label, t.target_date, f.predicted, f.target_quarter, CASE WHEN f.target_quarter = t.target_date THEN 1 WHEN {QEND.format(d='f.target_quarter')} = {QEND.format(d='t.target_date')} THEN 2 WHEN last_day(f.target_quarter) = last_day(t.target_date) THEN 3 ELSE 4 END AS m
    FROM ({FORECASTS}) f CROSS JOIN (SELECT unnest([DATE '1998-06-30', DATE '1998-08-15', DATE '2030-01-31']) AS target_date) t) ORDER BY model, label, target_date, m, target_quarter DESC)""")
def prediction_extract(spark, sf):
    f = forecasts(Tables(spark, sf)).select("model", "label", F.col("target_quarter").alias("period_date"), "predicted")
    days = F.array(*(F.lit(d).cast("date") for d in ("1998-06-30", "1998-08-15", "2030-01-31")))
    targets = f.select("model", "label").distinct().withColumn("target_date", F.explode(days))
    return ev.extracted(f, targets, ["model", "label"])


@query("actual_lookup", f"SELECT f.model, f.target_quarter, f.label, t.y FROM ({FORECASTS}) f LEFT JOIN (SELECT period_date, round(y, 6) AS y FROM ({TARGET})) t ON t.period_date = f.target_quarter")
def actual_lookup(spark, sf):
    t = Tables(spark, sf)
    y = target(t).select(F.col("period_date").alias("target_quarter"), F.round("y", 6).alias("y"))
    return forecasts(t).join(broadcast_if_small(y), "target_quarter", "left").select("model", "target_quarter", F.col("label").cast("long").alias("label"), "y")


_OPTIONS = "(SELECT DISTINCT p_size AS k FROM part), (SELECT DISTINCT r_regionkey AS lags FROM region), (SELECT unnest([80, 120]) AS train)"


def _options(t: Tables) -> dict[str, list]:
    """Option lists from the tables: part sizes and regions, a few dozen values whatever the scale."""
    return {"k": sorted(r[0] for r in t.part.select("p_size").distinct().collect()), "lags": sorted(r[0] for r in t.region.select("r_regionkey").distinct().collect())}


@query("config_grid", f"SELECT md5('{{\"k\":' || k || ',\"lags\":' || lags || ',\"train\":' || train || '}}') AS config_id, CAST(k AS INTEGER) AS k, CAST(lags AS INTEGER) AS lags, train FROM {_OPTIONS}")
def config_grid(spark, sf):
    return ev.config_grid(spark, **_options(Tables(spark, sf)), train=[80, 120]).select("config_id", *(F.col(c).cast("int").alias(c) for c in ("k", "lags", "train")))


@query("resume_anti", "SELECT CAST(k AS INTEGER) AS k, CAST(lags AS INTEGER) AS lags FROM (SELECT DISTINCT p_size AS k FROM part), (SELECT DISTINCT r_regionkey AS lags FROM region) WHERE (k, lags) NOT IN (SELECT (p_size, p_partkey % 5) FROM part WHERE p_partkey % 16 = 0)")
def resume_anti(spark, sf):
    """The configurations that the results so far, every 16th part standing in for them, do not have."""
    t = Tables(spark, sf)
    done = t.part.where("p_partkey % 16 = 0").select(F.col("p_size").cast("long").alias("k"), (F.col("p_partkey") % 5).cast("long").alias("lags"))
    return ev.pending(ev.config_grid(spark, **_options(t)), done, ["k", "lags"]).select(F.col("k").cast("int").alias("k"), F.col("lags").cast("int").alias("lags"))


LABELS = ["2020", "2020Q3", "2020-Q3", "2010K2", "2017-S1", "2024P2", "202013", "202012", "2020M7", "2020-07", "2020-07-15", "2020-W01", "2023-2024", "", "2021W53", "abc", "2020-13"]
#: Label -> first day and frequency, by hand.
LABEL_TABLE = {
    "2020": ("2020-01-01", "A"), "2020Q3": ("2020-07-01", "Q"), "2020-Q3": ("2020-07-01", "Q"), "2010K2": ("2010-04-01", "Q"),
    "2017-S1": ("2017-01-01", "S"), "2024P2": ("2024-07-01", "S"), "202013": (None, "M"), "202012": ("2020-12-01", "M"),
    "2020M7": ("2020-07-01", "M"), "2020-07": ("2020-07-01", "M"), "2020-07-15": ("2020-07-15", "D"), "2020-W01": ("2019-12-30", "W"),
    "2023-2024": ("2023-09-01", "SY"), "": (None, "M"), "2021W53": ("2022-01-03", "W"), "abc": (None, "M"), "2020-13": (None, "M"),
}


_D = "CAST(o_orderdate AS DATE)"


@query("period_labels", f"""SELECT DISTINCT CASE k WHEN 0 THEN strftime(d, '%Y') WHEN 1 THEN year(d) || 'Q' || quarter(d) WHEN 2 THEN strftime(d, '%Y-%m') WHEN 3 THEN strftime(d, '%Y%m') WHEN 4 THEN strftime(d, '%Y-%m-%d') WHEN 5 THEN year(d) || '-S' || (month(d) + 5) // 6 WHEN 6 THEN year(d) || 'M' || month(d) ELSE 'abc' END AS label,
  CAST(CASE k WHEN 0 THEN date_trunc('year', d) WHEN 1 THEN date_trunc('quarter', d) WHEN 4 THEN d WHEN 5 THEN CASE WHEN month(d) < 7 THEN date_trunc('year', d) ELSE date_trunc('year', d) + INTERVAL 6 MONTH END WHEN 7 THEN NULL ELSE date_trunc('month', d) END AS DATE) AS first_day,
  CASE k WHEN 0 THEN 'A' WHEN 1 THEN 'Q' WHEN 4 THEN 'D' WHEN 5 THEN 'S' ELSE 'M' END AS frequency FROM (SELECT {_D} AS d, o_orderkey % 8 AS k FROM orders)""")
def period_labels(spark, sf):
    """Every order's date as a label, in eight forms; LABEL_TABLE has the odd ones, for the tests."""
    d, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 8
    y, text = F.year(d).cast("string"), lambda pattern: F.date_format(d, pattern)
    forms = [text("yyyy"), F.concat(y, F.lit("Q"), F.quarter(d)), text("yyyy-MM"), text("yyyyMM"), text("yyyy-MM-dd"), F.concat(y, F.lit("-S"), F.floor((F.month(d) + 5) / 6).cast("string")), F.concat(y, F.lit("M"), F.month(d))]
    label = F.lit("abc")
    for n, form in enumerate(forms):
        label = F.when(k == n, form).otherwise(label)
    d = Tables(spark, sf).orders.select(label.alias("label")).distinct()
    return d.select("label", pf.period_start(F.col("label")).alias("first_day"), pf.period_frequency(F.col("label")).alias("frequency"))


@query("quarter_labels", f"SELECT period_date, CAST(year(period_date) AS VARCHAR) || 'Q' || quarter(period_date) AS label, period_date AS back FROM ({TARGET})")
def quarter_labels(spark, sf):
    d = target(Tables(spark, sf)).select("period_date", pf.quarter_label(F.col("period_date")).alias("label"))
    return d.withColumn("back", pf.quarter_of_label(F.col("label")))


@query("series_keys", "SELECT c_custkey, 'cust.nation=' || c_nationkey || '.seg=' || coalesce(seg, 'None') AS dotted, 'cust|nation=' || c_nationkey || '|seg=' || coalesce(seg, 'None') AS piped, regexp_replace(c_name || '_' || c_mktsegment, '\\s+', '_', 'g') AS joined FROM (SELECT *, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS seg FROM customer)")
def series_keys(spark, sf):
    c = Tables(spark, sf).customer.withColumn("seg", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")))
    parts = {"nation": F.col("c_nationkey"), "seg": F.col("seg")}
    return c.select("c_custkey", pf.dotted_key(F.lit("cust"), **parts).alias("dotted"), pf.piped_key(F.lit("cust"), **parts).alias("piped"), pf.joined_key(F.col("c_name"), F.col("c_mktsegment")).alias("joined"))


_WORDS = {"monthly": "M", "Q": "Q", " daily ": "D", "ANNUAL": "A", "fortnight": "M", "w": "W"}


@query("frequency_alias", f"SELECT c_custkey, raw, CASE raw {' '.join(f"WHEN '{w}' THEN '{c}'" for w, c in _WORDS.items())} END AS code FROM (SELECT c_custkey, [{', '.join(f"'{w}'" for w in _WORDS)}][c_custkey % 6 + 1] AS raw FROM customer)")
def frequency_alias(spark, sf):
    raw = F.element_at(F.array(*map(F.lit, _WORDS)), (F.col("c_custkey") % 6 + 1).cast("int"))
    return Tables(spark, sf).customer.select("c_custkey", raw.alias("raw"), pf.frequency_code(raw).alias("code"))
