"""The bitemporal store: as-of reads, idempotent appends, dimension merges, releases and late-data re-reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["series_id", "period_date"]
ROWS_PER_FILE = 200_000


def as_of(obs: DataFrame, moment: Column | None = None, key: list[str] = KEY, observed: str = "observed_at", tie: str | None = None) -> DataFrame:
    """The row of each key that was known last at the moment (or at all); ``tie`` settles equal times, the largest first.

    The filter on the moment reaches the scan; one shuffle on the key follows.
    """
    known = obs if moment is None else obs.where(F.col(observed) <= moment)
    order = [F.desc(observed), *([F.desc(tie)] if tie else [])]
    return known.withColumn("__k", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("__k = 1").drop("__k")


def latest_vintage_of_series(obs: DataFrame, series: str = "series_id", observed: str = "observed_at") -> DataFrame:
    """Rows observed at their series' last moment; earlier vintages' history is hidden on purpose (see as_of otherwise)."""
    return obs.withColumn("__last", F.max(observed).over(W.partitionBy(series))).where(F.col(observed) == F.col("__last")).drop("__last")


def revisions_per_point(obs: DataFrame, key: list[str] = KEY) -> DataFrame:
    return obs.groupBy(*key).agg(F.count(F.lit(1)).alias("n_vintages"))


def new_rows(batch: DataFrame, stored: DataFrame, key: list[str] = [*KEY, "observed_at"], tie: str | None = None) -> DataFrame:
    """The batch without rows whose key is stored, one row for each key: what an idempotent append adds.

    The store's keys stand before the batch's rows of the same key in one window, so either side is shuffled and sorted
    once (row_number would sort before the shuffle too). A null is a key like any other.
    """
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in batch.schema if f.name not in key]
    known = stored.select(*key, *rest, F.lit(False).alias("__new"))
    order = [F.col("__new"), *([F.desc(tie)] if tie else [])]
    both = known.unionByName(batch.withColumn("__new", F.lit(True)))
    first = both.withColumn("__k", F.lag(F.lit(1)).over(W.partitionBy(*key).orderBy(*order)))
    return first.where("__k is null and __new").select(*(F.col(f.name).cast(f.dataType) for f in batch.schema))


def append_idempotent(batch: DataFrame, path: str, key: list[str] = [*KEY, "observed_at"], tie: str | None = None, date: str = "period_date") -> int:
    """Appends the batch's new rows to the Parquet store at path; gives their number.

    Of the store only rows within the batch's range of dates are read, where the date is part of the key. The number of
    files goes by the number of rows, however many shuffle partitions hold them.
    """
    spark = batch.sparkSession
    try:
        stored = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        stored = batch.limit(0)
    if date in key:
        low, high, gaps = batch.agg(F.min(date), F.max(date), F.count_if(F.col(date).isNull())).first()
        within = F.col(date).between(low, high) if low is not None else F.lit(False)
        stored = stored.where(within | F.col(date).isNull() if gaps else within)
    fresh = new_rows(batch, stored, key, tie).persist()
    try:
        n = fresh.count()
        if n:
            fresh.coalesce(-(-n // ROWS_PER_FILE)).write.mode("append").parquet(path)
        return n
    finally:
        fresh.unpersist()


def merge_dimension(old: DataFrame, new: DataFrame, key: list[str], keep_old_if_null: list[str] = (), overwrite: list[str] = ()) -> DataFrame:
    """Upsert: coalesced columns keep the old value where the new one is null, overwritten ones take the new row's."""
    o, n = old.alias("o"), new.withColumn("__new", F.lit(True)).alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key]
    both = o.join(n, on, "full")
    columns = [F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in [*key, *keep_old_if_null]]
    columns += [F.when(F.col("n.__new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in overwrite]
    rest = [c for c in old.columns if c not in {*key, *keep_old_if_null, *overwrite}]
    return both.select(*columns, *(F.coalesce(f"o.{c}", f"n.{c}").alias(c) if c in new.columns else F.col(f"o.{c}").alias(c) for c in rest))


def merge_maps(old: Column, new: Column) -> Column:
    """Union of two string maps; on a shared key the new value unless it is null; keys without any value go."""
    empty = F.expr("map()").cast("map<string,string>")
    return F.map_filter(F.map_zip_with(F.coalesce(old, empty), F.coalesce(new, empty), lambda k, o, n: F.coalesce(n, o)), lambda k, v: v.isNotNull())


def merge_json(old: Column, new: Column) -> Column:
    return F.to_json(merge_maps(F.from_json(old, "map<string,string>"), F.from_json(new, "map<string,string>")))


def last_hash(releases: DataFrame, scope: Column, at: str, content_hash: Column) -> DataFrame:
    """scope, last_at, last_hash: the newest release of each scope."""
    return releases.groupBy(scope.alias("scope")).agg(F.max(at).alias("last_at"), F.max_by(content_hash, F.col(at)).alias("last_hash"))


def unchanged_skipped(payloads: DataFrame, releases: DataFrame) -> DataFrame:
    """payloads (scope, content_hash) whose hash is not their scope's last one."""
    last = releases.select("scope", F.col("last_hash").alias("content_hash"))
    return payloads.join(last, ["scope", "content_hash"], "left_anti")


def tail(obs: DataFrame, days: int = 7, series: str = "series_id", date: str = "period_date") -> DataFrame:
    """Each series' rows from ``days`` before its last date on: what an update reads again."""
    return obs.withColumn("__hi", F.max(date).over(W.partitionBy(series))).where(F.col(date) >= F.date_sub("__hi", days)).drop("__hi")


def keep_last(df: DataFrame, key: list[str], order: str) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(W.partitionBy(*key).orderBy(F.desc(order)))).where("__k = 1").drop("__k")


def surrogate_id(*natural: Column) -> Column:
    """The same key gives the same id in every run."""
    return F.xxhash64(*natural)


def recent_vintages(obs: DataFrame, most: int, series: str = "series_id", date: str = "period_date", vintage: str = "vintage", observed: str = "observed_at", tie: str | None = None) -> DataFrame:
    """Rows of each series' last ``most`` vintage days: of each period what was known last on that day."""
    days = obs.select(series, vintage).distinct()
    kept = days.withColumn("__k", F.row_number().over(W.partitionBy(series).orderBy(F.desc(vintage)))).where(F.col("__k") <= most).drop("__k")
    return as_of(obs.join(kept, [series, vintage]), None, [series, date, vintage], observed, tie)


def update_starts(series: DataFrame, stored: DataFrame, first: str, key: str = "series_id", date: str = "period_date") -> DataFrame:
    """key, start, initial: the day after the last stored date, or ``first`` for a series that has nothing stored."""
    last = stored.groupBy(key).agg(F.max(date).alias("last"))
    d = series.select(key).join(last, key, "left")
    return d.select(key, F.coalesce(F.date_add("last", 1), F.lit(first).cast("date")).alias("start"), F.col("last").isNull().alias("initial"))
