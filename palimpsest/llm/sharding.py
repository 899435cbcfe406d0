"""Balanced contiguous shards from global byte-size prefix sums. DataFrame operations only.

Rows are put in one global order (text hash, doc_id), so that equal texts lie side by side. Range partitioning on
both keys splits even a text that holds a third of all rows. Each partition's total gives the offset of the next
one; a row's prefix sum is its partition's offset plus its running sum inside the partition, and the shards are cut
where prefix sums pass equal targets. A cut inside a run of equal texts moves to the nearer end of the run when that
unbalances a shard by at most ``slack`` of its size; longer runs are cut where they are.

Nulls: a null text has size 1 and the CRC of no bytes; a null doc_id sorts first. Repeated rows each get a slot.
An empty table gives an empty result. A text of any length is one row of one shard. Further columns, whatever their
names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import table, text_or_empty, written


def shard_by_bytes(
    docs: DataFrame, shards: int = 16, slack: float = 0.005, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, shard, slot (gapless in its shard), start (bytes before it)."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    text = text_or_empty(text_col)
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
    )
    order = ["h", "text_crc32", "size", "doc_id"]
    # The written table fixes which row lies in which partition, whatever is lost and run again later.
    rows = written(sized.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # one row a partition
    total = sum(r["bytes"] for r in totals)
    offsets, before_bytes, before_rows = [], 0, 0
    for r in totals:
        offsets.append((r["part"], before_bytes, before_rows))
        before_bytes, before_rows = before_bytes + r["bytes"], before_rows + r["n"]
    offsets = F.broadcast(spark.createDataFrame(offsets, "part int, o_bytes long, o_rows long"))
    inside = W.partitionBy("part").orderBy(*order)
    placed = (
        rows.withColumns({"run": F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, -1)), "nth": F.row_number().over(inside)})
        .join(offsets, "part")
        .withColumns({"start": F.col("o_bytes") + F.coalesce("run", F.lit(0)), "index": F.col("o_rows") + F.col("nth") - 1})
    )
    placed = written(placed.select("doc_id", "size", "text_crc32", "h", "start", "index"))
    cuts = _settled([total * k // shards for k in range(1, shards)], placed, slack * total / shards)
    shard: Column = F.lit(0)
    for c in cuts:
        shard = shard + (F.col("start") >= F.lit(c)).cast("int")
    out = placed.withColumn("shard", shard)
    first = F.broadcast(out.groupBy("shard").agg(F.min("index").alias("first")))  # a row for each shard
    return out.join(first, "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("index") - F.col("first")).alias("slot"), "start")


def _settled(targets: list[int], placed: DataFrame, slack: float) -> list[int]:
    """The cuts, moved out of runs of equal texts where the nearer end of the run is within slack."""
    if not targets:
        return []
    crossed = F.lit(False)
    for t in targets:
        crossed = crossed | ((F.col("start") < t) & (F.col("start") + F.col("size") > t)) | (F.col("start") == t)
    hashes = [r["h"] for r in placed.where(crossed).select("h").distinct().collect()]  # at most one for each target
    runs = placed.where(F.col("h").isin(hashes)).groupBy("h").agg(F.min("start").alias("lo"), F.max(F.col("start") + F.col("size")).alias("hi")).collect() if hashes else []
    out = []
    for t in targets:
        run = next(((r["lo"], r["hi"]) for r in runs if r["lo"] < t < r["hi"]), None)
        end = min(run, key=lambda x: abs(x - t)) if run else t
        out.append(end if abs(end - t) <= slack else t)
    return sorted(out)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    out = shard_by_bytes(table(spark, sf_dir, "documents"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
