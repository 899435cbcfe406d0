"""URL allow and block rules by expression expansion and hash-prefix joins. DataFrame operations only.

Each distinct (host, path) is expanded into the host suffixes (on label borders) and path prefixes that a rule can have:
one for each distinct number of labels of a rule's host, and each distinct length of a rule's path. Expressions meet the rules by an equi-join on the
first hex digits of their SHA-256; a hit counts only if the full digests agree. Of the confirmed rules the longest
wins, and of equally long ones ``block`` before ``allow``. Without a rule the verdict is ``default``.

Nulls: a null url, or one without ``://``, has empty host and path, which no rule fits. Repeated rows each get a row.
An empty table of pages gives an empty result; without rules every page gets the default. URLs are judged whole, in time
that grows with their length. Further columns, whatever their names, are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import maybe_broadcast, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The query's rules: verdict, host, path. (fixed values)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: A helper column's name, made anew by each driver.
LONE = f"__{uuid.uuid4().hex}"
SHAPE = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", prefix_hex: int = 8, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """pages' id, host, path, rule and verdict; rules has the columns verdict, host and path."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    split = pages.select(
        F.col(id_col),
        F.translate(F.regexp_extract(url, SHAPE, 1), UPPER, LOWER).alias("host"),
        F.regexp_extract(url, SHAPE, 2).alias("path"),
    )
    digest = lambda x: F.sha2(x, 256)
    rule = F.concat("host", "path")
    count = lambda host: F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1  # noqa: E731  of labels
    listed = rules.dropna(subset=["verdict", "host", "path"]).select(rule.alias("rule"), "verdict", F.length("path").alias("path_chars"), count(F.col("host")).alias("labels"))
    listed = listed.groupBy("rule", "path_chars", "labels").agg(F.max("verdict").alias("verdict"))  # block sorts after allow
    # Rules' hosts and paths have at most as many counts and lengths as a URL has characters.
    lengths, depths = (sorted(r[0] for r in listed.select(c).distinct().collect()) for c in ("path_chars", "labels"))
    keyed = listed.select("rule", "verdict", digest(F.col("rule")).alias("rule_digest")).withColumn("key", F.substring("rule_digest", 1, prefix_hex))
    suffixes = F.filter(F.array(*[F.when(count(F.col("host")) >= n, F.substring_index("host", ".", -n)) for n in depths]), lambda x: x.isNotNull()) if depths else F.array().cast("array<string>")
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]), lambda x: x.isNotNull()) if lengths else F.array().cast("array<string>")
    # One expansion for each distinct key: a URL or host that holds a third of all rows is expanded once.
    keys = split.where(F.col("host") != "").select("host", "path").distinct()
    expanded = keys.select("host", "path", F.explode(suffixes).alias("suffix")).select("host", "path", F.explode(F.transform(prefixes, lambda p: F.concat("suffix", p))).alias("expression"))
    expanded = expanded.withColumn("digest", digest(F.col("expression"))).withColumn("key", F.substring("digest", 1, prefix_hex))
    hits = expanded.join(maybe_broadcast(keyed, 300), "key").where(F.col("digest") == F.col("rule_digest"))
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule"), F.col("verdict"), F.col("rule"))).alias("best"))
    # Pages without a host fit no rule: they are dealt by their id, not by the one key that they share.
    lone = F.when(F.col("host") == "", F.pmod(F.xxhash64(id_col), F.lit(1024))).otherwise(F.lit(-1))
    return split.withColumn(LONE, lone).join(best.withColumn(LONE, F.lit(-1).cast("long")), [LONE, "host", "path"], "left").select(
        id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict under the fixed rules."""
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


OP10_SQL = r"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS pos FROM pages
), r AS (
  SELECT page_id, CASE WHEN pos > 0 THEN substr(url, pos + 3) ELSE '' END AS rest FROM u
), s AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM r
), rules(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), fit AS (
  SELECT s.page_id, s.host, s.path, rules.h || rules.p AS rule, rules.verdict,
         row_number() OVER (PARTITION BY s.page_id ORDER BY length(rules.h || rules.p) DESC NULLS LAST) AS k
  FROM s LEFT JOIN rules ON (s.host = rules.h OR ends_with(s.host, '.' || rules.h)) AND starts_with(s.path, rules.p)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fit WHERE k = 1
"""
