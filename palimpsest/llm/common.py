"""Shared helpers of the training-data operators: tables, shared folders, row locators."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The byte set that separates words everywhere in this subpackage.
WHITE = " \t\n\x0b\f\r"
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
#: Columns that name a physical row. The names are made anew by each driver, so no caller's column can have them.
FILE, ROW = (f"__{x}_{uuid.uuid4().hex}" for x in ("file", "row"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder that driver and executors both see.

    The cluster names the parent in spark.checkpoint.dir; where that is unset, a session whose driver and executors are
    one process (tests) gets a local folder, and any other an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file:///tmp/palimpsest"
    return f"{root.rstrip('/')}/palimpsest-{uuid.uuid4().hex}"


def written(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors.

    Meanwhile batches for Python hold BATCH_BYTES at most, so that rows of any width take bounded memory on both sides.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    before = spark.conf.get(BATCH, None)
    spark.conf.set(BATCH, BATCH_BYTES)
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(BATCH, before) if before is not None else spark.conf.unset(BATCH)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for t in tables:
        jvm, path = t.sparkSession._jvm, t.scratch_path
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def located(df: DataFrame) -> DataFrame:
    """df with FILE long and ROW long, which name each physical row (even of repeated rows).

    A frame read from files gives them itself; any other frame is first written to the shared folder. Whatever columns
    the caller has, ``_metadata`` included, stay as they are.
    """
    if {FILE, ROW} <= set(df.columns):
        return df

    def placed(x: DataFrame) -> DataFrame:
        place = x.metadataColumn("_metadata")
        return x.select("*", F.xxhash64(place["file_path"]).alias(FILE), place["row_index"].alias(ROW))

    try:
        out = placed(df)
        out.schema  # noqa: B018  resolves the hidden columns
        return out
    except AnalysisException:
        return placed(written(df))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def small_enough(df: DataFrame, row_bytes: int, limit: int = 32 << 20) -> bool:
    """Whether df's counted rows, at row_bytes each and what a hashed relation adds to a row, may be broadcast."""
    return df.count() * (row_bytes + 48) <= limit


def maybe_broadcast(df: DataFrame, row_bytes: int, limit: int = 32 << 20) -> DataFrame:
    """df marked for broadcast only when its counted size is within the limit; else left to shuffle joins."""
    return F.broadcast(df) if small_enough(df, row_bytes, limit) else df
