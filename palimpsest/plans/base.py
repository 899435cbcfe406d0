"""Registration of queries with their SQL, and the stand-in inputs that they share, in both dialects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.periods import month_end, quarter_end

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


class Tables:
    """The tables of one folder, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def cents(column: str):
    """An exact sum of amounts in cents, as a double: the same in whatever order rows are summed."""
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double")


def panel(t: Tables) -> DataFrame:
    """series_id, period_date (month end), value: monthly shipped amounts by return flag and status."""
    d = t.lineitem.select(F.concat("l_returnflag", "l_linestatus").alias("series_id"), month_end(F.col("l_shipdate").cast("date")).alias("period_date"), "l_extendedprice")
    return d.groupBy("series_id", "period_date").agg(cents("l_extendedprice").alias("value"))


PANEL = """
  SELECT l_returnflag || l_linestatus AS series_id, last_day(CAST(l_shipdate AS DATE)) AS period_date,
         CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value
  FROM lineitem GROUP BY ALL
"""


def gappy(t: Tables) -> DataFrame:
    """series_id (nation and priority), period_date, value: monthly order amounts; months without orders are absent."""
    d = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    d = d.select(F.concat_ws("/", F.col("c_nationkey").cast("string"), "o_orderpriority").alias("series_id"), month_end(F.col("o_orderdate").cast("date")).alias("period_date"), "o_totalprice")
    return d.groupBy("series_id", "period_date").agg(cents("o_totalprice").alias("value"))


GAPPY = """
  SELECT CAST(c_nationkey AS VARCHAR) || '/' || o_orderpriority AS series_id, last_day(CAST(o_orderdate AS DATE)) AS period_date,
         CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL
"""

#: gappy on its dense calendar.
GAPPY_DENSE = f"""
  SELECT g.series_id, g.period_date, p.value FROM (
    SELECT series_id, last_day(CAST(unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), INTERVAL 1 MONTH)) AS DATE)) AS period_date
    FROM (SELECT series_id, min(period_date) AS lo, max(period_date) AS hi FROM ({GAPPY}) GROUP BY series_id)
  ) g LEFT JOIN ({GAPPY}) p USING (series_id, period_date)
"""


def revised(t: Tables) -> DataFrame:
    """series_id, period_date, observed_at, value, event_id: several events of a user's day are its revisions."""
    e = t.events
    return e.select(F.col("user_id").alias("series_id"), F.col("ts").cast("date").alias("period_date"), F.col("ts").alias("observed_at"), "value", "event_id", "event_type", "props")


REVISED = "SELECT user_id AS series_id, CAST(ts AS DATE) AS period_date, ts AS observed_at, value, event_id, event_type, props FROM events"


def target(t: Tables) -> DataFrame:
    """period_date (quarter end), value, y: quarterly orders and their log difference to four quarters before."""
    from pyspark.sql import Window as W

    q = t.orders.groupBy(quarter_end(F.col("o_orderdate").cast("date")).alias("period_date")).agg(cents("o_totalprice").alias("value"))
    return q.withColumn("y", F.ln("value") - F.lag(F.ln("value"), 4).over(W.orderBy("period_date")))


QEND = "last_day(CAST(date_trunc('quarter', CAST({d} AS DATE)) + INTERVAL 2 MONTH AS DATE))"
TARGET = f"""
  SELECT period_date, value, ln(value) - lag(ln(value), 4) OVER (ORDER BY period_date) AS y FROM (
    SELECT {QEND.format(d='o_orderdate')} AS period_date, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM orders GROUP BY ALL)
"""


def forecasts(t: Tables) -> DataFrame:
    """model, target_quarter, label, predicted, actual: a month's value forecast by values of 1 to 5 months before."""
    from pyspark.sql import Window as W

    w = W.partitionBy("series_id").orderBy("period_date")
    d = panel(t).withColumn("p", F.array(*(F.lag("value", k).over(w) for k in (5, 4, 3, 2, 1))))
    d = d.select(F.col("series_id").alias("model"), F.col("period_date").alias("target_quarter"), F.col("value").alias("actual"), F.posexplode("p").alias("k", "predicted"))
    return d.where("predicted is not null").select("model", "target_quarter", (F.col("k") - 2).alias("label"), "predicted", "actual")


FORECASTS = f"""
  SELECT model, target_quarter, label, predicted, actual FROM (
    SELECT series_id AS model, period_date AS target_quarter, value AS actual, unnest([-2, -1, 0, 1, 2]) AS label,
           unnest([lag(value, 5) OVER w, lag(value, 4) OVER w, lag(value, 3) OVER w, lag(value, 2) OVER w, lag(value, 1) OVER w]) AS predicted
    FROM ({PANEL}) WINDOW w AS (PARTITION BY series_id ORDER BY period_date)) WHERE predicted IS NOT NULL
"""
