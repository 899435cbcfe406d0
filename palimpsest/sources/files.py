"""File sources: panels, CSV snapshots, wide statistics tables, JSON records and delimited text."""

from __future__ import annotations

import fnmatch
import json
import os
import random
import re
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.periods import period_frequency, period_start


def _place() -> Column:
    """A row's place in its files' order, however they are split: file, start of the split, and order in the split."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"))


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """A wide panel by its suffix, its date column named period_date, the last row of each date in the order of files."""
    df = spark.read.csv(path, header=True, inferSchema=True) if path.endswith(".csv") else spark.read.parquet(path)
    date = next((c for c in ("period_date", "month_end") if c in df.columns), None)
    if date is None:
        raise ValueError(f"{path} has neither period_date nor month_end")
    df = df.withColumn(date, F.col(date).cast("date")).withColumnRenamed(date, "period_date").withColumn("__n", _place())
    return df.withColumn("__k", F.row_number().over(W.partitionBy("period_date").orderBy(F.desc("__n")))).where("__k = 1").drop("__k", "__n")


def find_panel(folder: str, explicit: str | None = None, prefix: str = "panel_", legacy: tuple[str, ...] = ("panel.parquet", "panel.csv")) -> str:
    """The explicit path, else the newest prefix*.parquet, else a legacy name; FileNotFoundError if there is none."""
    if explicit:
        path = explicit if os.path.isabs(explicit) else os.path.join(folder, explicit)
        if os.path.exists(path):
            return path
        raise FileNotFoundError(path)
    found = [os.path.join(folder, f) for f in os.listdir(folder) if fnmatch.fnmatch(f, f"{prefix}*.parquet")]
    if found:
        return max(found, key=lambda p: (os.path.getmtime(p), p))
    for name in legacy:
        if os.path.exists(path := os.path.join(folder, name)):
            return path
    raise FileNotFoundError(f"no panel in {folder}")


def meta_path(panel_path: str) -> str:
    """panel_X.parquet -> meta_X.csv beside it."""
    folder, name = os.path.split(panel_path)
    return os.path.join(folder, re.sub(r"^(.*?)panel_?(.*)\.(parquet|csv)$", r"\1meta_\2.csv", name))


def resolve_target(wanted: str | None, columns: list[str], keys: dict[str, str] | None = None, defaults: tuple[str, ...] = ("GDPC1", "GDP")) -> str:
    """A column by exact name, else by a unique substring of its series key (any case), else a default."""
    if wanted:
        if wanted in columns:
            return wanted
        hits = [c for c in columns if wanted.upper() in (keys or {}).get(c, "").upper()]
        if hits:
            return hits[0]
        raise KeyError(wanted)
    for d in defaults:
        if d in columns:
            return d
    raise ValueError("no target column")


def to_long(wide: DataFrame, date: str = "period_date", drop_null: bool = True) -> DataFrame:
    """Numeric columns of a wide panel as series_id, period_date, value."""
    numeric = [f.name for f in wide.schema if f.name != date and f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte", "decimal")]
    out = wide.select(date, *(F.col(c).cast("double").alias(c) for c in numeric)).unpivot([date], numeric, "series_id", "value")
    return out.where("value is not null") if drop_null else out


def to_wide(long: DataFrame, ids: list[str], date: str = "period_date", series: str = "series_id", value: str = "value") -> DataFrame:
    """One row per date, a column for each listed series; listing them saves a pass over the data."""
    return long.groupBy(date).pivot(series, ids).agg(F.max(value))


def label_columns(columns: list[str]) -> list[str]:
    """The columns whose names begin with four digits, a year."""
    return [c for c in columns if re.match(r"\d{4}", c.strip())]


def unpivot_labels(wide: DataFrame) -> DataFrame:
    """A wide statistics table as its dimensions, label, period_date, frequency and value (null if not a number)."""
    labels = label_columns(wide.columns)
    dims = [c for c in wide.columns if c not in labels]
    long = wide.select(*dims, *(F.col(f"`{c}`").cast("string").alias(c) for c in labels)).unpivot(dims, [f"`{c}`" for c in labels], "label", "raw")
    label = F.trim(F.regexp_replace("label", "`", ""))
    return long.select(*dims, label.alias("label"), period_start(label).alias("period_date"), period_frequency(label).alias("frequency"), F.regexp_replace(F.trim("raw"), ",", ".").try_cast("double").alias("value"))


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, int]]:
    """(wide panel, transform codes) of a CSV whose first data row may hold the codes; rows of no date are left out."""
    raw = spark.read.csv(path, header=True)
    date, rest = raw.columns[0], raw.columns[1:]
    is_code = F.lower(F.trim(F.regexp_replace(F.col(f"`{date}`"), ":", ""))).isin("transform", "tcode", "tcodes")
    codes = {c: int(float(v)) for r in raw.where(is_code).limit(1).collect() for c, v in r.asDict().items() if c != date and v}
    day = F.coalesce(*(F.try_to_timestamp(F.trim(F.col(f"`{date}`")), F.lit(f)).cast("date") for f in ("M/d/yyyy", "yyyy-MM-dd")))
    panel = raw.select(day.alias("period_date"), *(F.col(f"`{c}`").try_cast("double").alias(c) for c in rest)).where("period_date is not null")
    return panel, codes


def json_records(payloads: DataFrame, path: str, schema: str, column: str = "body") -> DataFrame:
    """The records at a path of keys and list indexes inside each JSON payload; a payload without it gives no rows."""
    at = F.get_json_object(column, path)
    many = F.when(F.ltrim(at).startswith("["), at).when(at.isNotNull(), F.concat(F.lit("["), at, F.lit("]")))
    return payloads.select(F.explode(F.from_json(many, f"array<struct<{schema}>>")).alias("r")).select("r.*")


def read_delimited(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8", skip: int = 0) -> DataFrame:
    """Delimited text; with skip, each file's first lines before its header are dropped. Files are split as any text."""
    if not skip:
        return spark.read.csv(path, header=True, sep=sep, encoding=encoding)
    # A file's first lines are in its first split, one after another: they are those next to its smallest number there.
    lines = spark.read.text(path).withColumn("at", _place())
    first = lines.where("at.start = 0").groupBy(F.col("at.file").alias("file")).agg(F.min("at.n").alias("first"))
    numbered = lines.join(F.broadcast(first), F.col("at.file") == F.col("file")).withColumn("line", F.when(F.col("at.start") == 0, F.col("at.n") - F.col("first")).otherwise(F.lit(skip + 1)))
    head = numbered.where(F.col("line") == skip).orderBy("file").select("value").first()
    if head is None:
        raise ValueError(f"{path} has no header after {skip} lines")
    names = ", ".join(f"`{h.strip()}` string" for h in head[0].rstrip("\r").split(sep))
    rows = numbered.where((F.col("line") > skip) & (F.trim("value") != "")).select(F.regexp_replace("value", "\r$", "").alias("line"))
    return rows.select(F.from_csv("line", F.lit(names), {"sep": sep}).alias("r")).select("r.*")


def normalised(records: DataFrame, key: Column, date: Column, value: Column, provider: str, frequency: Column | None = None, unit: Column | None = None, country: Column | None = None, transform: Column | None = None) -> DataFrame:
    """Any records in the common form period_date, value, series_key, frequency, unit, country, transform, provider."""
    empty = F.lit(None).cast("string")
    out = records.select(
        date.alias("period_date"), F.regexp_replace(F.trim(value.cast("string")), ",", ".").try_cast("double").alias("value"), key.alias("series_key"),
        *((empty if c is None else c).alias(n) for c, n in ((frequency, "frequency"), (unit, "unit"), (country, "country"), (transform, "transform"))), F.lit(provider).alias("provider"),
    )
    return out.where("period_date is not null and value is not null and series_key is not null")


def content_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """path, content_hash of raw payload files, for unchanged payloads to be skipped."""
    return spark.read.format("binaryFile").load(folder).select("path", F.sha2("content", 256).alias("content_hash"))


def read_results(spark: SparkSession, folder: str, pattern: str = "*predictions_*.csv") -> DataFrame:
    """All result files under a folder, however deep, with their file name; broken lines go to _corrupt_record."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).csv(folder, header=True, mode="PERMISSIVE").withColumn("file", F.col("_metadata.file_name"))


def consolidated(spark: SparkSession, paths: list[str], date: str = "period_date") -> DataFrame:
    """Wide chunk files with different columns as one long panel: series_id, date, value; a gap is no row.

    One scan, whatever the number of chunks: columns that a file lacks are null in it, and only what is there is unfolded.
    """
    wide = spark.read.option("mergeSchema", True).parquet(*paths)
    cells = F.from_json(F.to_json(F.struct(*(F.col(f"`{c}`").cast("double").alias(c) for c in wide.columns if c != date))), "map<string,double>")
    return wide.select(date, F.explode(cells).alias("series_id", "value")).select("series_id", date, "value")


def first_config(paths: list[str]) -> dict:
    """The first of the JSON files that is there; YAML too where its library is."""
    for p in paths:
        if os.path.exists(p):
            with open(p) as f:
                if p.endswith((".yml", ".yaml")):
                    import yaml

                    return yaml.safe_load(f)
                return json.load(f)
    raise FileNotFoundError(", ".join(paths))


def with_retry(read: Callable, tries: int = 3, wait: float = 2.0, sleep: Callable[[float], None] = time.sleep, keep: bool = False, only: tuple[type[Exception], ...] = (Exception,)):
    """read(), again after a pause that doubles, with up to a second of jitter, until the tries are used up.

    A DataFrame is lazy: a scan that fails later is outside. With keep its rows are stored in the shared folder within
    the try, so that failing scans are tried again too. Errors of other kinds than ``only`` are raised at once.
    """
    from palimpsest.sources.sinks import stored

    for k in range(tries):
        try:
            out = read()
            return stored(out) if keep else out
        except only:
            if k == tries - 1:
                raise
            sleep(wait**k + random.random())
    raise ValueError("tries must be 1 or more")


def earliest_dates(spark: SparkSession, path: str, by: str = "dataset", date: str = "period_date") -> DataFrame:
    """by, earliest of Parquet folders ``by``=..., from the files' statistics: no row is read.

    Only the second version of Spark's Parquet source answers aggregates from footers; a session of its own chooses it,
    so that the caller's session stays as it is. Dates are answered so, timestamps are not.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own.read.parquet(path).groupBy(by).agg(F.min(date).alias("earliest"))


def long_datasets(eligible: DataFrame, earliest: DataFrame, before: str, most: int | None = None, by: str = "dataset") -> DataFrame:
    """The eligible datasets that reach back to ``before``, the longest first, at most so many.

    eligible comes from the catalogue alone; the dates of the others are not looked at.
    """
    d = eligible.join(F.broadcast(earliest), by).where(F.col("earliest") <= F.lit(before).cast("date")).orderBy("earliest", by)  # a row for each dataset
    return d.limit(most) if most is not None else d
