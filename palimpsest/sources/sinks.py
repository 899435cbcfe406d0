"""Sinks: partitioned and wide Parquet, result checkpoints, dimension rewrites, audit rows, catalogue tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local one only where they are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file:///tmp/palimpsest"
    return root.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: what builds on it does not run it again, and a lost executor costs one stage."""
    path = f"{scratch(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_long(df: DataFrame, path: str, by: list[str] = ("provider",), mode: str = "overwrite") -> None:
    """Hive-partitioned long panel, clustered by series inside each file so that min/max statistics prune."""
    sort = [c for c in ("series_id", "period_date") if c in df.columns]
    df.repartition(*by, *sort[:1]).sortWithinPartitions(*by, *sort).write.mode(mode).partitionBy(*by).parquet(path)


def write_wide(df: DataFrame, path: str, ids: list[str], date: str = "period_date", series: str = "series_id", value: str = "value") -> None:
    df.groupBy(date).pivot(series, ids).agg(F.max(value)).orderBy(date).write.mode("overwrite").parquet(path)


def rewrite(spark: SparkSession, path: str, make) -> str:
    """Writes make(old frame) beside path and gives the new place: a table is never overwritten while it is read."""
    new = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    make(spark.read.parquet(path)).write.parquet(new)
    return new


def append_results(df: DataFrame, path: str, key: list[str]) -> int:
    """Appends results whose keys are not there yet; gives their number. A resumed search adds nothing twice."""
    from palimpsest.operators.bitemporal import append_idempotent

    return append_idempotent(df, path, key)


def release_row(dataset_id: Column, downloaded_at: Column, content_hash: Column, scope: Column, meta: Column | None = None) -> list[Column]:
    """Columns of a release, with its scope folded into the meta JSON."""
    from palimpsest.operators.bitemporal import merge_json

    scoped = F.to_json(F.struct(scope.alias("scope")))
    return [dataset_id.alias("dataset_id"), downloaded_at.alias("downloaded_at"), content_hash.alias("content_hash"), (scoped if meta is None else merge_json(meta, scoped)).alias("meta")]


def audit_row(spark: SparkSession, dataset_id: int, status: str, inserted: int, failed: int, details: dict | None = None) -> DataFrame:
    d = spark.createDataFrame([(dataset_id, status, inserted, failed, json.dumps(details or {}, sort_keys=True))], "dataset_id long, status string, rows_inserted int, rows_failed int, details string")
    return d.withColumn("run_time", F.current_timestamp())


def create_table(spark: SparkSession, name: str, ddl: str, by: list[str] = ()) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl}) USING parquet" + (f" PARTITIONED BY ({', '.join(by)})" if by else ""))


def analyze(spark: SparkSession, name: str) -> None:
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")


def truncate(spark: SparkSession, *names: str) -> None:
    for n in names:
        spark.sql(f"TRUNCATE TABLE {n}")


def reuse_cache(series: DataFrame, cache: DataFrame, growth: float = 0.10) -> tuple[DataFrame, DataFrame]:
    """(series with a cached decision that still holds, series to decide anew): it holds while n grew by at most ``growth``."""
    joined = series.join(cache.where("success").select("series_id", F.col("n").alias("cached_n"), "decision"), "series_id", "left")
    holds = F.col("cached_n").isNotNull() & (F.col("n") <= F.col("cached_n") * (1 + growth)) & (F.col("n") >= F.col("cached_n"))
    return joined.where(holds).drop("cached_n"), joined.where(~F.coalesce(holds, F.lit(False))).drop("cached_n", "decision")
