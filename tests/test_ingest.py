"""Flow ingest: digests that see every change, and skips by the scope's last release alone."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from palimpsest.operators.bitemporal import new_rows
from palimpsest.streaming.ingest import ingest_flow, payload_digest, read_stream, stream_append

KEY, SCHEMA = ["id", "at"], "id long, at long, lo double, hi double"


def test_digests_tell_shifted_nulls_and_repeated_rows_but_not_orders(spark):
    of = lambda *rows: payload_digest(spark.createDataFrame(rows, SCHEMA))
    a = (1, 1, None, 5.0)
    assert of(a) != of((1, 1, 5.0, None)) and of(a) != of(a, a) and of(a) != of((1, 1, None, None))
    b = (2, 1, 1.0, 2.0)
    assert of(a, b, b) == of(b, a, b) and payload_digest(spark.createDataFrame([(5.0, 1, None, 1)], "hi double, id long, lo double, at long")) == of(a)


def test_only_the_last_release_of_a_scope_counts(spark, tmp_path):
    a = spark.createDataFrame([(1, 1, None, 5.0)], SCHEMA)
    b = spark.createDataFrame([(1, 1, 5.0, None), (2, 1, 1.0, 1.0)], SCHEMA)
    run = lambda d, scope="s", **o: (lambda x: (x["status"], x["rows_inserted"]))(ingest_flow(d, str(tmp_path), KEY, scope=scope, **o))
    assert run(a, dry_run=True) == ("dry_run", 0)
    assert [run(d) for d in (a, a, b, b, a)] == [("ok", 1), ("skipped", 0), ("ok", 1), ("skipped", 0), ("ok", 0)]
    assert run(a, "other") == ("ok", 0) and run(a, "other") == ("skipped", 0)
    stored = spark.read.parquet(f"{tmp_path}/releases").orderBy("scope", "release").select("scope", "release").collect()
    assert [tuple(r) for r in stored] == [("other", 1), ("s", 1), ("s", 2), ("s", 3)]
    assert spark.read.parquet(f"{tmp_path}/observations").count() == 2


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)]])
def test_empty_and_null_payloads(spark, tmp_path, rows):
    d = spark.createDataFrame(rows, SCHEMA)
    assert [ingest_flow(d, str(tmp_path), KEY)["status"] for _ in range(2)] == ["ok", "skipped"]
    assert d.where(F.col("id").isNotNull()).count() == len(rows)


def test_new_rows_take_one_shuffle_for_nulls_ties_and_copies(spark):
    stored = spark.createDataFrame([(1, 1, 0.0, None), (1, 1, 9.0, None), (None, 1, 0.0, None), (3, None, 0.0, None)], SCHEMA)
    batch = spark.createDataFrame([(1, 1, 1.0, 1.0), (None, 1, 1.0, 1.0), (None, None, 1.0, 1.0), (None, None, 2.0, 4.0), (2, 1, None, 1.0), (2, 1, 3.0, None), (3, None, 5.0, 5.0), (4, 1, None, 7.0)], SCHEMA)
    d = new_rows(batch, stored, KEY, "lo")
    assert d.schema == batch.schema and {tuple(r) for r in d.collect()} == {(None, None, 2.0, 4.0), (2, 1, 3.0, None), (4, 1, None, 7.0)} and d.count() == 3
    assert new_rows(batch, stored, KEY).count() == 3 and new_rows(batch, stored.limit(0), KEY).count() == 6
    assert d._jdf.queryExecution().sparkPlan().toString().count("Window") == 1 and "Join" not in d._jdf.queryExecution().sparkPlan().toString()


def test_streamed_batches_write_files_by_rows_not_by_shuffle_partitions(spark, tmp_path):
    at = f"file://{tmp_path}"
    spark.range(400).selectExpr("id", "id as at", "1d as lo", "2d as hi").coalesce(1).write.parquet(f"{at}/in")
    for marks in ("a", "b"):
        stream_append(read_stream(spark, f"{at}/in", SCHEMA), f"{at}/store", f"{at}/{marks}", KEY).awaitTermination()
        assert spark.read.parquet(f"{at}/store").count() == 400 and len(list(Path(tmp_path, "store").glob("*.parquet"))) == 1


def test_the_streams_input_files_can_be_read_by_many_tasks(spark, monkeypatch, tmp_path):
    import pyarrow.parquet as pq

    from palimpsest.plans import source_queries

    monkeypatch.setattr(source_queries, "ROW_GROUP", 16 << 10)
    monkeypatch.setattr(source_queries, "_folder", lambda _: f"file://{tmp_path}/s")
    n = source_queries.stream_append(spark, "/root/testdata/sf0.01").count()
    files = list(Path(tmp_path, "s/in").glob("*.parquet"))
    assert n == 8045 and len(files) == 4 and all(pq.ParquetFile(f).num_row_groups > 1 for f in files)
