"""Bitemporal store, catalogue, quality and ingestion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import periods as pf
from palimpsest.operators import bitemporal as bt
from palimpsest.operators import quality as ql
from palimpsest.operators.sizes import broadcast_if_small
from palimpsest.plans.base import PANEL, REVISED, Tables, panel, query, revised

# Stand-ins: region = providers, nation = datasets, customer = series, orders = observations, supplier = ingestion log.


def _day(c: str):
    return F.col(c).cast("date")


@query("dim_join_3way", "SELECT c_custkey AS series_id, n_name AS dataset, r_name AS provider FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def dim_join_3way(spark, sf):
    t = Tables(spark, sf)
    d = t.customer.join(broadcast_if_small(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).join(broadcast_if_small(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    return d.select(F.col("c_custkey").alias("series_id"), F.col("n_name").alias("dataset"), F.col("r_name").alias("provider"))


@query("datasets_series_count", "SELECT r_name AS provider, n_name AS dataset, count(c_custkey) AS n_series FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def datasets_series_count(spark, sf):
    t = Tables(spark, sf)
    n = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("c_custkey").alias("n_series"))
    d = t.region.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey")).join(n, "n_nationkey", "left")
    return d.groupBy(F.col("r_name").alias("provider"), F.col("n_name").alias("dataset")).agg(F.coalesce(F.sum("n_series"), F.lit(0)).alias("n_series"))


@query("health_overview", "SELECT r_name AS provider, count(DISTINCT n_nationkey) AS n_datasets, count(DISTINCT c_custkey) AS n_series, count(o_orderkey) AS n_obs, CAST(max(o_orderdate) AS DATE) AS last_period FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def health_overview(spark, sf):
    t = Tables(spark, sf)
    # Observations are added up per series before any join, so the joins run over dimensions only.
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n"), F.max("o_orderdate").alias("hi"))
    d = t.region.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey"), "left").join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(o, "c_custkey", "left")
    return d.groupBy(F.col("r_name").alias("provider")).agg(F.countDistinct("n_nationkey").alias("n_datasets"), F.countDistinct("c_custkey").alias("n_series"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_obs"), F.max("hi").cast("date").alias("last_period"))


FRESH = "FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2"


@query("freshness_fanout", f"SELECT r_name AS provider, n_name AS dataset, count(DISTINCT c_custkey) AS n_series, count(o_orderkey) AS n_obs, CAST(max(o_orderdate) AS DATE) AS last_period, count(CASE WHEN s_acctbal < 0 THEN 1 END) AS error_runs {FRESH}")
def freshness_fanout(spark, sf):
    """Counts as the joined rows give them: observations times log rows. The product is formed from counts, never from rows."""
    t = Tables(spark, sf)
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n"), F.max("o_orderdate").alias("hi"))
    per = t.customer.join(o, "c_custkey", "left").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(
        F.countDistinct("c_custkey").alias("n_series"), F.coalesce(F.sum("n"), F.lit(0)).alias("obs"), F.sum(F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))).alias("rows"), F.max("hi").alias("hi"))
    log = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("s_acctbal") < 0).alias("bad"))
    d = t.region.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey")).join(per, "n_nationkey", "left").join(log, "n_nationkey", "left")
    return d.select(
        F.col("r_name").alias("provider"), F.col("n_name").alias("dataset"), F.coalesce("n_series", F.lit(0)).alias("n_series"),
        (F.coalesce("obs", F.lit(0)) * F.greatest(F.coalesce("runs", F.lit(0)), F.lit(1))).alias("n_obs"), F.col("hi").cast("date").alias("last_period"),
        (F.coalesce("bad", F.lit(0)) * F.greatest(F.coalesce("rows", F.lit(0)), F.lit(1))).alias("error_runs"),
    )


@query("freshness_correct", """SELECT r_name AS provider, n_name AS dataset, coalesce(n_series, 0) AS n_series, coalesce(n_obs, 0) AS n_obs, CAST(hi AS DATE) AS last_period, coalesce(bad, 0) AS error_runs
  FROM region JOIN nation ON n_regionkey = r_regionkey
  LEFT JOIN (SELECT c_nationkey, count(DISTINCT c_custkey) AS n_series, count(o_orderkey) AS n_obs, max(o_orderdate) AS hi FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT s_nationkey, count(CASE WHEN s_acctbal < 0 THEN 1 END) AS bad FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey""")
def freshness_correct(spark, sf):
    t = Tables(spark, sf)
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n"), F.max("o_orderdate").alias("hi"))
    per = t.customer.join(o, "c_custkey", "left").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.countDistinct("c_custkey").alias("s"), F.sum("n").alias("n"), F.max("hi").alias("hi"))
    log = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count_if(F.col("s_acctbal") < 0).alias("bad"))
    d = t.region.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey")).join(per, "n_nationkey", "left").join(log, "n_nationkey", "left")
    zero = lambda c, n: F.coalesce(c, F.lit(0)).alias(n)
    return d.select(F.col("r_name").alias("provider"), F.col("n_name").alias("dataset"), zero("s", "n_series"), zero("n", "n_obs"), F.col("hi").cast("date").alias("last_period"), zero("bad", "error_runs"))


@query("staleness_flag", """SELECT event_type AS source, round(epoch(TIMESTAMP '2024-02-01' - hi) / 3600, 6) AS hours,
  CASE WHEN hi IS NULL THEN 'never_run' WHEN epoch(TIMESTAMP '2024-02-01' - hi) / 3600 > CASE event_type WHEN 'click' THEN 36 ELSE 200 END THEN 'stale' ELSE 'fresh' END AS status
  FROM (SELECT event_type, date_trunc('second', max(ts)) AS hi FROM events GROUP BY 1 UNION ALL SELECT 'unused', NULL)""")
def staleness_flag(spark, sf):
    e = Tables(spark, sf).events.groupBy(F.col("event_type").alias("source")).agg(F.date_trunc("second", F.max("ts")).cast("timestamp").alias("last_run"))
    e = e.unionByName(spark.createDataFrame([("unused", None)], "source string, last_run timestamp"))
    limits = spark.createDataFrame([("click", 36)], "source string, limit_hours int")
    return ql.stale(e, limits, F.to_timestamp(F.lit("2024-02-01 00:00:00"))).withColumn("hours", F.round("hours", 6))


@query("gap_detect", "SELECT series_id, gap_start, gap_end, gap_days FROM (SELECT o_custkey AS series_id, lag(d) OVER (PARTITION BY o_custkey ORDER BY d) AS gap_start, d AS gap_end, d - lag(d) OVER (PARTITION BY o_custkey ORDER BY d) AS gap_days FROM (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders)) WHERE gap_days > 95 ORDER BY gap_days DESC, series_id, gap_start LIMIT 20")
def gap_detect(spark, sf):
    o = Tables(spark, sf).orders.select(F.col("o_custkey").alias("series_id"), _day("o_orderdate").alias("period_date")).distinct()
    return ql.gaps(o).withColumn("gap_days", F.col("gap_days").cast("long")).orderBy(F.desc("gap_days"), "series_id", "gap_start").limit(20)


@query("flatline_detect", """SELECT series_id, n, round(100.0 * r / n, 1) AS pct_repeated FROM (SELECT series_id, count(*) AS n, count(CASE WHEN value = p THEN 1 END) AS r FROM (
  SELECT user_id AS series_id, CAST(value < 60 AS INTEGER) AS value, lag(CAST(value < 60 AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) GROUP BY 1) WHERE n > 10 AND r > 0.5 * n ORDER BY pct_repeated DESC, series_id LIMIT 20""")
def flatline_detect(spark, sf):
    e = Tables(spark, sf).events.select(F.col("user_id").alias("series_id"), F.struct("ts", "event_id").alias("period_date"), (F.col("value") < 60).cast("int").alias("value"))
    return ql.flatlines(e).orderBy(F.desc("pct_repeated"), "series_id").limit(20)


@query("latest_vintage_series_level", f"SELECT series_id, event_id, period_date FROM ({REVISED}) r WHERE observed_at = (SELECT max(ts) FROM events WHERE user_id = r.series_id)")
def latest_vintage_series_level(spark, sf):
    return bt.latest_vintage_of_series(revised(Tables(spark, sf))).select("series_id", "event_id", "period_date")


MOMENT = "2024-01-15 12:00:00"


@query("asof_key_period", f"SELECT DISTINCT ON (series_id, period_date) series_id, period_date, event_id, value FROM ({REVISED}) WHERE observed_at <= TIMESTAMP '{MOMENT}' ORDER BY series_id, period_date, observed_at DESC, event_id DESC")
def asof_key_period(spark, sf):
    known = bt.as_of(revised(Tables(spark, sf)), F.lit(MOMENT).cast("timestamp_ntz"), tie="event_id")
    return known.select("series_id", "period_date", "event_id", "value")


@query("asof_pivot", f"SELECT series_id, max(CASE WHEN period_date = DATE '2024-01-10' THEN value END) AS d10, max(CASE WHEN period_date = DATE '2024-01-11' THEN value END) AS d11, max(CASE WHEN period_date = DATE '2024-01-12' THEN value END) AS d12 FROM (SELECT DISTINCT ON (series_id, period_date) series_id, period_date, value FROM ({REVISED}) WHERE observed_at <= TIMESTAMP '{MOMENT}' ORDER BY series_id, period_date, observed_at DESC, event_id DESC) GROUP BY 1")
def asof_pivot(spark, sf):
    known = bt.as_of(revised(Tables(spark, sf)), F.lit(MOMENT).cast("timestamp_ntz"), tie="event_id")
    return known.withColumn("k", F.concat(F.lit("d"), F.date_format("period_date", "dd"))).groupBy("series_id").pivot("k", ["d10", "d11", "d12"]).agg(
        F.max(F.when(F.date_format("period_date", "yyyy-MM") == "2024-01", F.col("value"))))


@query("latest_per_point", f"SELECT DISTINCT ON (series_id, period_date) series_id, period_date, event_id, value FROM ({REVISED}) ORDER BY series_id, period_date, observed_at DESC, event_id DESC")
def latest_per_point(spark, sf):
    return bt.as_of(revised(Tables(spark, sf)), tie="event_id").select("series_id", "period_date", "event_id", "value")


@query("point_in_time_by_type", f"SELECT DISTINCT ON (event_type, period_date) event_type AS key, period_date, event_id FROM ({REVISED}) WHERE observed_at <= TIMESTAMP '{MOMENT}' ORDER BY event_type, period_date, observed_at DESC, event_id DESC")
def point_in_time_by_type(spark, sf):
    d = revised(Tables(spark, sf)).withColumnRenamed("event_type", "key")
    return bt.as_of(d, F.lit(MOMENT).cast("timestamp_ntz"), key=["key", "period_date"], tie="event_id").select("key", "period_date", "event_id")


@query("revision_count", f"SELECT series_id, period_date, count(*) AS n_vintages FROM ({REVISED}) GROUP BY 1, 2")
def revision_count(spark, sf):
    return bt.revisions_per_point(revised(Tables(spark, sf)))


@query("ilike_search", "SELECT p_partkey, p_name, p_brand FROM part WHERE p_name ILIKE '%RED%' OR p_brand ILIKE '%#2%' OR p_type ILIKE '%red%'")
def ilike_search(spark, sf):
    p = Tables(spark, sf).part
    return p.where(F.col("p_name").ilike("%red%") | F.col("p_brand").ilike("%#2%") | F.col("p_type").ilike("%red%")).select("p_partkey", "p_name", "p_brand")


@query("keyword_search", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name ILIKE '%_1%' OR r_name ILIKE '%as%'")
def keyword_search(spark, sf):
    t = Tables(spark, sf)
    return ql.search(t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")), "_1", "n_name").select("n_nationkey", "n_name", "r_name").unionByName(
        ql.search(t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")), "as", "r_name").select("n_nationkey", "n_name", "r_name")).distinct()


@query("keyword_filter", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(lower(p_name), 'widget|gear')")
def keyword_filter(spark, sf):
    return Tables(spark, sf).part.where(F.lower("p_name").rlike("widget|gear")).select("p_partkey", "p_name")


@query("key_like", "SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%ring%' OR lower(p_name) LIKE '%blue%' OR p_name = 'red widget'")
def key_like(spark, sf):
    n = F.lower("p_name")
    return Tables(spark, sf).part.where(n.like("%ring%") | n.like("%blue%") | (F.col("p_name") == "red widget")).select("p_partkey")


@query("json_scope_last_hash", "SELECT k AS scope, sha256(CAST(arg_max(event_id, ts) AS VARCHAR)) AS last_hash FROM (SELECT CAST(json_extract(props, '$.k') AS VARCHAR) AS k, event_id, ts FROM events) GROUP BY 1")
def json_scope_last_hash(spark, sf):
    e = Tables(spark, sf).events
    return bt.last_hash(e, F.get_json_object("props", "$.k"), "ts", F.sha2(F.col("event_id").cast("string"), 256)).select("scope", "last_hash")


@query("exists_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def exists_semi(spark, sf):
    t = Tables(spark, sf)
    return t.customer.join(t.orders.where("o_orderpriority = '1-URGENT'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("missing_series", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def missing_series(spark, sf):
    t = Tables(spark, sf)
    return t.customer.join(t.orders.where("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("idempotent_append", f"""WITH r AS ({REVISED}), stored AS (SELECT DISTINCT series_id, period_date, event_type FROM r WHERE event_id % 3 = 0)
  SELECT series_id, period_date, event_type, max(event_id) AS event_id FROM r WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.series_id = r.series_id AND s.period_date = r.period_date AND s.event_type = r.event_type) GROUP BY 1, 2, 3""")
def idempotent_append(spark, sf):
    r = revised(Tables(spark, sf))
    new = bt.new_rows(r, r.where("event_id % 3 = 0"), ["series_id", "period_date", "event_type"], tie="event_id")
    return new.select("series_id", "period_date", "event_type", "event_id")


@query("dim_merge_coalesce", """SELECT coalesce(n.k, o.k) AS k, coalesce(n.unit, o.unit) AS unit, CASE WHEN n.k IS NOT NULL THEN n.name ELSE o.name END AS name
  FROM (SELECT c_custkey AS k, c_mktsegment AS unit, c_name AS name FROM customer WHERE c_custkey % 3 < 2) o
  FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_acctbal > 0 THEN 'u' || c_nationkey END AS unit, lower(c_name) AS name FROM customer WHERE c_custkey % 3 > 0) n ON o.k = n.k""")
def dim_merge_coalesce(spark, sf):
    c = Tables(spark, sf).customer
    old = c.where("c_custkey % 3 < 2").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("unit"), F.col("c_name").alias("name"))
    new = c.where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_acctbal") > 0, F.concat(F.lit("u"), F.col("c_nationkey").cast("string"))).alias("unit"), F.lower("c_name").alias("name"))
    return bt.merge_dimension(old, new, ["k"], keep_old_if_null=["unit"], overwrite=["name"])


@query("json_merge", "SELECT event_id, CAST(json_extract_string(json_merge_patch(props, '{\"type\": \"' || event_type || '\"}'), '$.k') AS INTEGER) AS k, event_type AS type FROM events")
def json_merge(spark, sf):
    e = Tables(spark, sf).events
    merged = bt.merge_json(F.col("props"), F.to_json(F.struct(F.col("event_type").alias("type"))))
    return e.select("event_id", F.get_json_object(merged, "$.k").cast("int").alias("k"), F.get_json_object(merged, "$.type").alias("type"))


@query("hash_skip", """WITH r AS (SELECT p_brand AS scope, sha256(p_name) AS h, p_partkey FROM part), last AS (SELECT scope, arg_max(h, p_partkey) AS h FROM r GROUP BY 1)
  SELECT DISTINCT r.scope, r.h AS content_hash FROM r WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.scope = r.scope AND l.h = r.h)""")
def hash_skip(spark, sf):
    p = Tables(spark, sf).part.select(F.col("p_brand").alias("scope"), F.sha2("p_name", 256).alias("content_hash"), "p_partkey")
    last = bt.last_hash(p, F.col("scope"), "p_partkey", F.col("content_hash"))
    return bt.unchanged_skipped(p.select("scope", "content_hash").distinct(), last)


@query("tail_reread", f"SELECT series_id, event_id FROM ({REVISED}) r WHERE period_date >= (SELECT max(CAST(ts AS DATE)) FROM events WHERE user_id = r.series_id) - 7")
def tail_reread(spark, sf):
    return bt.tail(revised(Tables(spark, sf)), 7).select("series_id", "event_id")


@query("vintage_loaded_skip", f"SELECT event_id FROM ({REVISED}) r WHERE NOT EXISTS (SELECT 1 FROM ({REVISED}) s WHERE s.series_id = r.series_id AND s.observed_at = r.observed_at AND s.event_id % 4 = 0)")
def vintage_loaded_skip(spark, sf):
    r = revised(Tables(spark, sf))
    return r.join(r.where("event_id % 4 = 0").select("series_id", "observed_at"), ["series_id", "observed_at"], "left_anti").select("event_id")


@query("in_filters", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus IN ('F')")
def in_filters(spark, sf):
    return Tables(spark, sf).orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & F.col("o_orderstatus").isin("F")).select("o_orderkey")


@query("regex_include_exclude", "SELECT n_name FROM nation WHERE regexp_matches(n_name, '^NATION_1?[0-9]$') AND NOT regexp_matches(n_name, '[37]$') ORDER BY n_name LIMIT 8 OFFSET 3")
def regex_include_exclude(spark, sf):
    n = Tables(spark, sf).nation
    return n.where(F.col("n_name").rlike("^NATION_1?[0-9]$") & ~F.col("n_name").rlike("[37]$")).orderBy("n_name").offset(3).limit(8).select("n_name")


@query("limited_datasets_semi", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3 ORDER BY n_name LIMIT 5)")
def limited_datasets_semi(spark, sf):
    t = Tables(spark, sf)
    few = t.nation.where("n_regionkey < 3").orderBy("n_name").limit(5).select(F.col("n_nationkey").alias("c_nationkey"))
    return t.customer.join(few, "c_nationkey", "left_semi").select("c_custkey")


@query("allowed_freqs", "SELECT c_custkey FROM customer WHERE upper(c_mktsegment) IN ('BUILDING', 'MACHINERY')")
def allowed_freqs(spark, sf):
    return Tables(spark, sf).customer.where(F.upper("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey")


@query("missing_classify", """SELECT p_partkey, CASE WHEN zero THEN 0.0 WHEN NOT blank THEN try_cast(replace(trim(raw), ',', '.') AS DOUBLE) END AS value,
  CASE WHEN zero THEN 'zero_status' WHEN blank THEN 'blank' WHEN try_cast(replace(trim(raw), ',', '.') AS DOUBLE) IS NULL THEN 'not_numeric' ELSE 'ok' END AS reason FROM (
  SELECT *, p_partkey % 11 = 0 AS zero, raw IS NULL OR trim(raw) IN ('', '-') AS blank FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN '-' WHEN 2 THEN 'n/a' WHEN 3 THEN NULL ELSE p_size || ',5' END AS raw FROM part))""")
def missing_classify(spark, sf):
    p = Tables(spark, sf).part
    k = F.col("p_partkey") % 5
    raw = F.when(k == 0, " ").when(k == 1, "-").when(k == 2, "n/a").when(k == 3, None).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(",5")))
    p = p.select("p_partkey", raw.alias("raw"), F.when(F.col("p_partkey") % 11 == 0, "dydis0").alias("status"))
    value, reason = ql.classify_raw(F.col("raw"), F.col("status"))
    return p.select("p_partkey", value.alias("value"), reason.alias("reason"))


@query("discard_counts", """SELECT p_brand, reason, n FROM (SELECT p_brand, CASE WHEN p_size < 10 THEN 'small' WHEN p_size > 40 THEN 'large' ELSE 'ok' END AS reason, count(*) AS n FROM part GROUP BY 1, 2) ORDER BY n DESC, p_brand, reason LIMIT 50""")
def discard_counts(spark, sf):
    p = Tables(spark, sf).part
    reason = F.when(F.col("p_size") < 10, "small").when(F.col("p_size") > 40, "large").otherwise("ok")
    return p.groupBy("p_brand", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p_brand", "reason").limit(50)


@query("content_hashes", "SELECT doc_id, sha256(text) AS content_hash, md5(lang || ':' || source) AS config_id FROM documents")
def content_hashes(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", F.sha2("text", 256).alias("content_hash"), F.md5(F.concat_ws(":", "lang", "source")).alias("config_id"))


@query("keep_last", f"SELECT series_id, period_date, max(event_id) AS event_id FROM ({REVISED}) GROUP BY 1, 2")
def keep_last(spark, sf):
    return bt.keep_last(revised(Tables(spark, sf)), ["series_id", "period_date"], "event_id").select("series_id", "period_date", "event_id")


@query("stalest_series", "SELECT o_custkey AS series_id, CAST(max(o_orderdate) AS DATE) AS last_date, count(*) AS n FROM orders GROUP BY 1 ORDER BY last_date, series_id LIMIT 10")
def stalest_series(spark, sf):
    o = Tables(spark, sf).orders
    return o.groupBy(F.col("o_custkey").alias("series_id")).agg(F.max(_day("o_orderdate")).alias("last_date"), F.count(F.lit(1)).alias("n")).orderBy("last_date", "series_id").limit(10)


@query("series_timespan", "SELECT o_custkey AS series_id, CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi, count(*) AS n FROM orders GROUP BY 1")
def series_timespan(spark, sf):
    o = Tables(spark, sf).orders
    return o.groupBy(F.col("o_custkey").alias("series_id")).agg(F.min(_day("o_orderdate")).alias("lo"), F.max(_day("o_orderdate")).alias("hi"), F.count(F.lit(1)).alias("n"))


@query("left_keys_found", "SELECT c_custkey, lower(trim(c_name)) AS key, n_name, n_name IS NOT NULL AS found FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON c_nationkey = n_nationkey")
def left_keys_found(spark, sf):
    t = Tables(spark, sf)
    d = t.customer.join(t.nation.where("n_nationkey % 2 = 0"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return d.select("c_custkey", pf.normal_key(F.col("c_name")).alias("key"), "n_name", F.col("n_name").isNotNull().alias("found"))


@query("union_pages", f"SELECT series_id, period_date, value, CAST(NULL AS VARCHAR) AS page FROM ({PANEL}) WHERE series_id LIKE 'A%' UNION ALL SELECT series_id, period_date, NULL, 'second' FROM ({PANEL}) WHERE series_id NOT LIKE 'A%'")
def union_pages(spark, sf):
    p = panel(Tables(spark, sf))
    return p.where("series_id like 'A%'").unionByName(p.where("series_id not like 'A%'").drop("value").withColumn("page", F.lit("second")), allowMissingColumns=True)


@query("set_ops", """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '5-LOW')
  SELECT 'union' AS op, count(*) AS n, CAST(sum(k) AS BIGINT) AS s FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'intersect', count(*), CAST(sum(k) AS BIGINT) FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'except', count(*), CAST(sum(k) AS BIGINT) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)""")
def set_ops(spark, sf):
    o = Tables(spark, sf).orders
    a, b = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")), o.where("o_orderpriority = '5-LOW'").select(F.col("o_custkey").alias("k"))
    one = lambda d, op: d.agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("s")).select(F.lit(op).alias("op"), "n", "s")
    return one(a.union(b).distinct(), "union").union(one(a.intersect(b), "intersect")).union(one(a.subtract(b), "except"))


@query("distinct_codes", "SELECT DISTINCT p_type AS code FROM part")
def distinct_codes(spark, sf):
    return Tables(spark, sf).part.select(F.col("p_type").alias("code")).distinct()
