"""Frequencies, dimensions, seasonality and targets told from metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import metadata as me
from palimpsest.plans.base import Tables, query

NAMES = ["Mokslo metai", "Metai", "Ketvirtis", "Pusmetis", "Mėnuo", "Savaitė", "Diena", "kita"]
IDS = ["", "3", "q", "h", "2", "W", "x"]
_LISTED = "[" + ", ".join(f"'{x}'" for x in NAMES) + "]"
_IDS = "[" + ", ".join(f"'{x}'" for x in IDS) + "]"


def _sql_frequency() -> str:
    whens = " ".join(
        f"WHEN {' OR '.join(f'contains(name, {w!r})' for w in words)} OR id IN ({', '.join(map(repr, ids))}) THEN '{f}'" for f, words, ids in me.FREQUENCY_WORDS
    )
    return f"CASE {whens} ELSE 'M' END"


@query("attribute_frequency", f"SELECT p_partkey, {_sql_frequency()} AS frequency FROM (SELECT p_partkey, lower({_LISTED}[p_size % 8 + 1]) AS name, lower({_IDS}[p_partkey % 7 + 1]) AS id FROM part)")
def attribute_frequency(spark, sf):
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("p_size") % 8 + 1).cast("int"))
    id_ = F.element_at(F.array(*map(F.lit, IDS)), (F.col("p_partkey") % 7 + 1).cast("int"))
    return Tables(spark, sf).part.select("p_partkey", me.attribute_frequency(name, id_, F.lit("M")).alias("frequency"))


@query("guessed_dimensions", """SELECT o_orderkey, CASE WHEN o_custkey % 5 > 0 THEN CAST(o_custkey % 25 AS VARCHAR) ELSE 'EU' END AS country,
  CASE WHEN o_orderkey % 7 = 0 THEN 'W' WHEN o_orderkey % 3 = 0 THEN 'Q' WHEN o_orderkey % 3 = 1 THEN 'M' ELSE 'A' END AS frequency FROM orders""")
def guessed_dimensions(spark, sf):
    year = F.year("o_orderdate").cast("string")
    label = F.when(F.col("o_orderkey") % 3 == 0, F.concat(year, F.lit("Q1"))).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM")).otherwise(year)
    return Tables(spark, sf).orders.select(
        "o_orderkey", me.guessed_country(F.when(F.col("o_custkey") % 5 > 0, F.col("o_custkey") % 25)).alias("country"), me.guessed_frequency(F.when(F.col("o_orderkey") % 7 == 0, "W"), label).alias("frequency")
    )


_TEXT = "lower(CASE p_size % 4 WHEN 0 THEN p_name || ' s_adj=NSA' WHEN 1 THEN p_name || ' seasonally adjusted' WHEN 2 THEN p_name || ' Not seasonally adjusted' ELSE p_name END)"


@query("metadata_seasonality", f"""SELECT p_partkey, kind, CASE kind WHEN 'nsa' THEN true WHEN 'sa' THEN false ELSE p_size > 20 END AS seasonal FROM (SELECT p_partkey, p_size,
  CASE WHEN {' OR '.join(f"contains(t, '{w}')" for w in me.UNADJUSTED)} THEN 'nsa' WHEN {' OR '.join(f"contains(t, '{w}')" for w in me.ADJUSTED)} THEN 'sa' ELSE 'unknown' END AS kind FROM (SELECT *, {_TEXT} AS t FROM part))""")
def metadata_seasonality(spark, sf):
    k = F.col("p_size") % 4
    text = F.concat("p_name", F.when(k == 0, " s_adj=NSA").when(k == 1, " seasonally adjusted").when(k == 2, " Not seasonally adjusted").otherwise(""))
    d = Tables(spark, sf).part.select("p_partkey", me.seasonality(text).alias("kind"), (F.col("p_size") / 100).alias("acf"))
    return d.select("p_partkey", "kind", me.seasonal(F.col("kind"), F.col("acf")).alias("seasonal"))


_FITS = "CASE WHEN p_type LIKE '%PROMO%' AND p_name LIKE '%ring%' AND p_size < 10 THEN 0 WHEN p_type LIKE '%PROMO%' AND p_size < 10 THEN 1 WHEN p_type LIKE '%PROMO%' THEN 2 END"


@query("target_cascade", f"SELECT p_brand, level, p_partkey FROM (SELECT p_brand, p_partkey, {_FITS} AS level, row_number() OVER (PARTITION BY p_brand ORDER BY {_FITS}, p_partkey) AS k FROM part WHERE {_FITS} IS NOT NULL) WHERE k = 1")
def target_cascade(spark, sf):
    """The target of each brand: the strictest predicate that any of its parts fits, then the smallest key."""
    promo, small = F.col("p_type").contains("PROMO"), F.col("p_size") < 10
    d = me.first_match(Tables(spark, sf).part.select("p_brand", "p_partkey", "p_name", "p_type", "p_size"), [promo & F.col("p_name").contains("ring") & small, promo & small, promo], "p_partkey", ["p_brand"])
    return d.select("p_brand", "level", "p_partkey")


@query("target_preference", "SELECT p_partkey, p_size FROM part WHERE p_type LIKE '%SMALL%' ORDER BY p_size <> 7, p_partkey LIMIT 1")
def target_preference(spark, sf):
    small_type = F.col("p_type").contains("SMALL")
    return me.first_match(Tables(spark, sf).part.select("p_partkey", "p_size", "p_type"), [small_type & (F.col("p_size") == 7), small_type], "p_partkey").select("p_partkey", "p_size")


@query("dynamic_predicates", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal >= 0 AND c_name ILIKE '%1%' AND c_nationkey BETWEEN 3 AND 20")
def dynamic_predicates(spark, sf):
    where = me.conjunction({"c_mktsegment": ["BUILDING", "MACHINERY"], "c_acctbal": (">=", 0), "c_name": ("like", "%1%"), "c_nationkey": ("between", (3, 20)), "c_custkey": None})
    return Tables(spark, sf).customer.where(where).select("c_custkey")


@query("discovered_datasets", """SELECT o_custkey AS code, array_to_string(list_sort(list_filter(list_distinct(list(left(o_orderpriority, 1))), lambda x: x IN ('1', '2'))), ',') AS freqs FROM orders
  GROUP BY 1 HAVING list_contains(list(o_orderstatus), 'F') AND len(list_filter(list(left(o_orderpriority, 1)), lambda x: x IN ('1', '2'))) > 0""")
def discovered_datasets(spark, sf):
    """Customers as datasets, their order states as places and the first digit of their priorities as frequencies."""
    o = Tables(spark, sf).orders.groupBy(F.col("o_custkey").alias("code")).agg(F.collect_set("o_orderstatus").alias("geos"), F.collect_set(F.substring("o_orderpriority", 1, 1)).alias("freqs"))
    return me.discovered(o, "F", ["1", "2"]).select("code", F.array_join("freqs", ",").alias("freqs"))


@query("keyword_batches", 'SELECT p_brand AS "group", p_type AS word, CAST(floor((row_number() OVER (PARTITION BY p_brand ORDER BY p_type) - 1) / 5) AS INTEGER) AS batch FROM (SELECT DISTINCT p_brand, p_name AS p_type FROM part)')
def keyword_batches(spark, sf):
    return me.batched(Tables(spark, sf).part.select(F.col("p_brand").alias("group"), F.col("p_name").alias("word")).distinct())
