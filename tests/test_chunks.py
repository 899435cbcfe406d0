"""Chunked work: a killed run and broken files resume to the same result, and nothing whole runs again."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from palimpsest.sources import chunks

SCHEMA = "id long, text string, half double"


def make(calls, fail_on=None):
    def run(asked):
        calls.append(sorted(r.chunk for r in asked.select("chunk").distinct().collect()))
        d = asked.select("chunk", F.col("id"), F.concat(F.lit('a "quoted" line, '), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 3 > 0, F.col("id") / 2).alias("half"))
        if fail_on:
            d = d.withColumn("half", F.when(F.col("chunk") == fail_on, F.raise_error(F.lit("killed")).cast("double")).otherwise(F.col("half")))
        return d

    return run


@pytest.fixture
def tasks(spark):
    return spark.range(40).select((F.col("id") % 5).cast("string").alias("chunk"), "id")


def whole(df):
    return sorted(map(tuple, df.collect()))


def test_a_killed_run_and_broken_files_resume_to_the_same_result(spark, tmp_path, tasks):
    root, calls = str(tmp_path / "a"), []
    want = whole(chunks.run(tasks, make([]), str(tmp_path / "b"), SCHEMA)[0])
    assert len(want) == 40
    with pytest.raises(Exception, match="killed"):
        chunks.run(tasks, make(calls, "3"), root, SCHEMA)
    out, n = chunks.run(tasks, make(calls), root, SCHEMA)
    assert n == 5 and whole(out) == want
    out, n = chunks.run(tasks, make(calls), root, SCHEMA)
    assert n == 0 and whole(out) == want and len(calls) == 2
    file = sorted(glob.glob(f"{root}/results/chunk=2/*.json"))[0]
    text = open(file).read()
    open(file, "w").write(text[: len(text) - 15])  # cut off inside its last line
    os.path.exists(f := os.path.join(os.path.dirname(file), f".{os.path.basename(file)}.crc")) and os.remove(f)
    out, n = chunks.run(tasks, make(calls), root, SCHEMA)
    assert n == 1 and calls[-1] == ["2"] and whole(out) == want and len(glob.glob(f"{root}/quarantine/2-*.json")) == 1


def test_lost_rows_new_chunks_and_empty_chunks(spark, tmp_path, tasks):
    root, calls = str(tmp_path / "a"), []
    few = tasks.where("chunk in ('0', '1')")
    assert chunks.run(few, make(calls), root, SCHEMA)[1] == 2
    for file in glob.glob(f"{root}/results/chunk=1/*.json"):
        os.remove(file)
    out, n = chunks.run(tasks, make(calls), root, SCHEMA)
    assert n == 4 and calls[-1] == ["1", "2", "3", "4"] and len(whole(out)) == 40
    assert len(whole(chunks.run(few, make(calls), root, SCHEMA)[0])) == 16
    nothing = lambda asked: make([])(asked).where("id < 0")
    out, n = chunks.run(tasks.where("chunk = '4'").withColumn("chunk", F.lit("e")), nothing, root, SCHEMA)
    assert n == 1 and whole(out) == [] and chunks.run(tasks.where("chunk = '4'").withColumn("chunk", F.lit("e")), nothing, root, SCHEMA)[1] == 0


def test_delimited_files_keep_their_own_first_lines_apart(spark, tmp_path):
    from palimpsest.sources import files

    for k in range(3):
        (tmp_path / f"f{k}.txt").write_text("note\nmore\r\na;b\r\n" + "".join(f"{k};{j}\r\n" for j in range(400)) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        d = files.read_delimited(spark, str(tmp_path), ";", skip=2)
        assert d.columns == ["a", "b"] and d.rdd.getNumPartitions() > 3
        assert sorted((int(r.a), int(r.b)) for r in d.collect()) == [(k, j) for k in range(3) for j in range(400)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_the_last_row_of_a_date_is_the_files_last(spark, tmp_path):
    from palimpsest.sources import files

    (tmp_path / "panel.csv").write_text("period_date,x\n" + "".join(f"2020-01-{1 + k % 28:02d},{k}\n" for k in range(2000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = {r.period_date.day: r.x for r in files.read_panel(spark, str(tmp_path / "panel.csv")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {1 + k % 28: k for k in range(1972, 2000)}


def test_a_failing_scan_is_tried_again(spark):
    from palimpsest.sources import files

    tries = []

    def read():
        tries.append(1)
        return spark.range(3).select(F.when(F.lit(len(tries) < 3), F.raise_error(F.lit("down")).cast("long")).otherwise(F.col("id")).alias("id"))

    assert files.with_retry(read, keep=True, sleep=lambda s: None).count() == 3 and len(tries) == 3
    with pytest.raises(KeyError):
        files.with_retry(lambda: {}["x"], only=(OSError,), sleep=lambda s: tries.append(2))
    assert 2 not in tries


def test_earliest_dates_come_from_the_files_statistics(spark, tmp_path, capsys):
    import datetime as dt

    from palimpsest.sources import files

    rows = [(k % 4, dt.date(2000 + k % 4, 1, 1) + dt.timedelta(days=k)) for k in range(200)]
    spark.createDataFrame(rows, "dataset int, period_date date").write.partitionBy("dataset").parquet(str(tmp_path / "d"))
    d = files.earliest_dates(spark, str(tmp_path / "d"))
    d.explain("formatted")
    assert "PushedAggregation: [MIN(period_date)]" in capsys.readouterr().out
    assert {r.dataset: r.earliest for r in d.collect()} == {k: dt.date(2000 + k, 1, 1) + dt.timedelta(days=k) for k in range(4)}
    eligible = spark.createDataFrame([(1, "b"), (2, "c"), (3, "d")], "dataset int, name string")
    assert [r.name for r in files.long_datasets(eligible, d, "2002-12-31").collect()] == ["b", "c"]
    assert spark.conf.get("spark.sql.sources.useV1SourceList") != ""
