"""Exact deduplication with stateful streaming. DataFrame and SQL operations only.

Texts are equal when identical after white space (space and 09 to 0D hex) is deleted. A narrow table (digest, id,
locator, length) is streamed into a keyed aggregation whose state lives in RocksDB on disk and has no watermark, so
no key ever expires: for each digest it retains the number of rows and the best row's length, stable identifier and
content locator (file and row). Partial aggregation before the shuffle keeps a group of any size cheap. Every hit is
then checked on full bytes: all rows of groups of two or more are read again by locator and their normalised texts
compared. Should a digest ever hold different texts, its rows are grouped anew by the text itself.

The table comes in several micro-batches (a third of its files each, ``MOST_FILES`` at most), so a row is looked up
among all that earlier batches have left in the state. An empty table runs none and gives an empty result. A text of
any length is one value of one row; only its digest is kept. Further columns, whatever their names, are not read.

Of equal texts the longest original (code points), then the smallest doc_id, then the first physical row stays;
repeated rows therefore keep exactly one. A null text counts as empty; a null doc_id loses to any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import FILE, ROW, WHITE, located, maybe_broadcast, shared_dir, small_enough, table, text_or_empty, written

MOST_FILES = 4096
BEST = "struct<chars:int,id:long,file:long,row:long>"
#: The state lives on disk; without fallocate a store with few keys takes the bytes of its keys, not of its empty logs.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def _normal(text_col: str) -> Column:
    return F.translate(text_or_empty(text_col), WHITE, "")


def _state(narrow_path: str, schema, spark: SparkSession, files_per_batch: int) -> DataFrame:
    """digest, best, group_size: the stream's keyed state after all rows of the narrow table."""
    keep = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    out, marks = shared_dir(spark), shared_dir(spark)
    state = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(narrow_path)
        .groupBy("digest")
        .agg(F.max(F.struct("chars", F.bitwise_not("doc_id").alias("id"), F.bitwise_not(FILE).alias("file"), F.bitwise_not(ROW).alias("row"))).alias("best"), F.count(F.lit(1)).alias("group_size"))
    )
    # Update mode: each batch writes the state rows that it changed; the last batch that names a digest has its final state.
    save = lambda batch, k: batch.withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(f"{out}/batch={k}")
    try:
        state.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    try:
        rows = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    except Exception as e:  # an empty table runs no batch at all
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"digest string, best {BEST}, group_size long")
    return rows.groupBy("digest").agg(F.max_by(F.struct("best", "group_size"), "batch").alias("s")).select("digest", "s.best", "s.group_size")


def _files(spark: SparkSession, path: str) -> int:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getFileCount()


def dedup_exact(docs: DataFrame, files_per_batch: int | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, and its locator (FILE, ROW)."""
    spark = docs.sparkSession
    docs = located(docs)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), FILE, ROW)
    narrow = texts.select("doc_id", F.sha2(_normal("text"), 256).alias("digest"), F.length(text_or_empty("text")).alias("chars"), FILE, ROW)
    path = shared_dir(spark)
    narrow.write.option("compression", "zstd").parquet(path)
    rows = spark.read.schema(narrow.schema).parquet(path)
    state = _state(path, narrow.schema, spark, files_per_batch or min(MOST_FILES, -(-_files(spark, path) // 3)))
    joined = rows.join(state, "digest").select("doc_id", "digest", "chars", FILE, ROW, "group_size", "best")
    joined = written(joined)
    wrong = _differing(texts, joined)
    out = joined
    if wrong is not None:
        out = joined.join(maybe_broadcast(wrong, 100), "digest", "left_anti").unionByName(_by_text(texts, joined, wrong))
    kept = (F.col(FILE) == F.bitwise_not("best.file")) & (F.col(ROW) == F.bitwise_not("best.row"))
    return out.select("doc_id", F.bitwise_not("best.id").alias("keep_id"), "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"), FILE, ROW)


def _hit_texts(texts: DataFrame, hits: DataFrame) -> DataFrame:
    """The normalised texts of the hits, fetched by locator."""
    side = F.broadcast(hits) if small_enough(hits, 100) else hits
    return texts.select(FILE, ROW, _normal("text").alias("normal")).join(side, [FILE, ROW])


def _differing(texts: DataFrame, joined: DataFrame) -> DataFrame | None:
    """The digests whose rows differ in bytes; None when there are none, as always but for a digest collision."""
    hits = joined.where("group_size > 1").select(FILE, ROW, "digest")
    # min and max merge copies before the shuffle, so a huge group sends one text from each task.
    same = _hit_texts(texts, hits).groupBy("digest").agg(F.min("normal").alias("a"), F.max("normal").alias("b"))
    wrong = written(same.where(F.col("a") != F.col("b")).select("digest"))
    return None if wrong.isEmpty() else wrong


def _by_text(texts: DataFrame, joined: DataFrame, wrong: DataFrame) -> DataFrame:
    """The rows of colliding digests, grouped by the whole normalised text instead."""
    rows = joined.join(wrong, "digest").select("doc_id", "digest", "chars", FILE, ROW)
    rows = written(_hit_texts(texts, rows))
    best = F.max(F.struct("chars", F.bitwise_not("doc_id").alias("id"), F.bitwise_not(FILE).alias("file"), F.bitwise_not(ROW).alias("row"))).alias("best")
    return rows.join(rows.groupBy("normal").agg(best, F.count(F.lit(1)).alias("group_size")), "normal").select(*joined.columns)


def keep_unique(docs: DataFrame) -> DataFrame:
    """docs without the rows that are exact copies of a row that stays; its columns unchanged."""
    docs = located(docs)
    kept = dedup_exact(docs).where("kept").select(FILE, ROW)
    side = F.broadcast(kept) if small_enough(kept, 16) else kept
    return docs.join(side, [FILE, ROW], "left_semi").drop(FILE, ROW)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stays for its text."""
    return dedup_exact(table(spark, sf_dir, "documents")).drop(FILE, ROW)


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
