"""Work in chunks that outlives its driver: results by chunk, a manifest of what is whole, and a place for broken files.

A chunk's rows are written first and its line in the manifest afterwards; a chunk without a line, with other rows than
its line says, or with a file that cannot be parsed is run again, and nothing else is.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "chunk string, rows long"
CORRUPT = "_corrupt_record"


def results(spark: SparkSession, root: str, schema: str) -> DataFrame | None:
    """chunk, file, the schema's columns and CORRUPT (a line that cannot be parsed) of every stored line; None before any
    chunk is stored."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/results/chunk=*")
    if not list(place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place) or ()):
        return None
    lines = spark.read.schema("value string, chunk string").text(f"{root}/results")
    row = F.from_json("value", f"{schema}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return lines.select("chunk", F.input_file_name().alias("file"), row.alias("row")).select("chunk", "file", "row.*")


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """chunk, rows: the last line of each chunk."""
    try:
        d = spark.read.schema(f"{MANIFEST}, at timestamp").parquet(f"{root}/manifest")
    except AnalysisException:
        return spark.createDataFrame([], MANIFEST)
    return d.groupBy("chunk").agg(F.max_by("rows", "at").alias("rows"))


def quarantine(spark: SparkSession, root: str, schema: str) -> list[str]:
    """Moves files with a line that cannot be parsed to root/quarantine; gives their chunks."""
    found = results(spark, root, schema)
    if found is None:
        return []
    bad = found.where(F.col(CORRUPT).isNotNull()).select("chunk", "file").distinct().collect()  # few, or the folder is lost anyway
    hadoop = spark._jvm.org.apache.hadoop.fs
    for r in bad:
        old, new = hadoop.Path(r.file), hadoop.Path(f"{root}/quarantine/{r.chunk}-{uuid.uuid4().hex}.json")
        store = old.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(new.getParent())
        if not store.rename(old, new):
            raise OSError(f"{r.file} could not be moved")
    return sorted({r.chunk for r in bad})


def missing(spark: SparkSession, root: str, schema: str, chunks: DataFrame) -> DataFrame:
    """The chunks (chunk) that are not whole: no line in the manifest, or another number of rows than it says."""
    found = results(spark, root, schema)
    whole = manifest(spark, root)
    if found is None:
        return chunks
    stored = found.groupBy("chunk").agg(F.count(F.lit(1)).alias("stored"))
    whole = whole.join(stored, "chunk", "left").where(F.col("rows") == F.coalesce("stored", F.lit(0)))
    return chunks.join(whole.select("chunk"), "chunk", "left_anti")


def run(tasks: DataFrame, make: Callable[[DataFrame], DataFrame], root: str, schema: str) -> tuple[DataFrame, int]:
    """(schema's rows of all chunks, number of chunks that were run): tasks has the column chunk and whatever make needs.

    make gives chunk and the schema's columns for the tasks it gets, which are those of all missing chunks, as one plan.
    A chunk is written whole in place of what a broken run left of it.
    """
    spark = tasks.sparkSession
    quarantine(spark, root, schema)
    chunks = tasks.select(F.col("chunk").cast("string").alias("chunk")).distinct()
    names = StructType.fromDDL(schema).fieldNames()
    # Which chunks are missing is settled before they are written: the folder changes meanwhile.
    todo = missing(spark, root, schema, chunks)
    path = f"{root}/todo-{uuid.uuid4().hex}"
    todo.write.parquet(path)
    todo = spark.read.schema("chunk string").parquet(path)
    n = todo.count()
    if n:
        asked = tasks.withColumn("chunk", F.col("chunk").cast("string")).join(todo, "chunk", "left_semi")
        made = make(asked).select(F.col("chunk").cast("string").alias("chunk"), *names)
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", "false").partitionBy("chunk").json(f"{root}/results")
        stored = results(spark, root, schema).groupBy("chunk").agg(F.count(F.lit(1)).alias("rows"))
        lines = todo.join(stored, "chunk", "left").select("chunk", F.coalesce("rows", F.lit(0)).alias("rows"), F.current_timestamp().alias("at"))
        lines.write.mode("append").parquet(f"{root}/manifest")
    found = results(spark, root, schema)
    return (spark.createDataFrame([], schema) if found is None else found.join(chunks, "chunk", "left_semi").select(*names)), n
