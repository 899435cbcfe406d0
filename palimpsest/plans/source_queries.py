"""Source queries: unpivoting, records, cubes, pages, and the streaming twins of ingestion."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from palimpsest.plans.base import PANEL, REVISED, Tables, panel, query, revised
from palimpsest.sources import files, paged, sdmx, sinks
from palimpsest.streaming import ingest


@query("unpivot_wide", f"SELECT series_id, strftime(period_date, '%Y-%m') AS label, CAST(date_trunc('month', period_date) AS DATE) AS period_date, 'M' AS frequency, round(value, 2) AS value FROM ({PANEL})")
def unpivot_wide(spark, sf):
    """The panel as a statistics table with a column for each month, and back."""
    p = panel(Tables(spark, sf)).withColumn("label", F.date_format("period_date", "yyyy-MM"))
    months = sorted(r[0] for r in p.select("label").distinct().collect())  # a wide table's columns
    wide = p.groupBy("series_id").pivot("label", months).agg(F.max("value"))
    return files.unpivot_labels(wide).where("value is not null").withColumn("value", F.round("value", 2))


@query("panel_round_trip", f"SELECT series_id, period_date, round(value, 4) AS value FROM ({PANEL})")
def panel_round_trip(spark, sf):
    wide = files.to_wide(panel(Tables(spark, sf)), ["AF", "AO", "NF", "NO", "RF", "RO"])
    return files.to_long(wide).select("series_id", "period_date", F.round("value", 4).alias("value"))


@query("json_records", "SELECT event_id, user_id, event_type FROM events")
def json_records(spark, sf):
    e = Tables(spark, sf).events.select("event_id", "user_id", "event_type")
    pages = e.groupBy((F.col("event_id") / 500).cast("int").alias("page")).agg(F.collect_list(F.struct("event_id", "user_id", "event_type")).alias("records"))
    bodies = pages.select(F.to_json(F.struct(F.struct("records").alias("data"))).alias("body"))
    return files.json_records(bodies, "$.data.records", "event_id bigint, user_id bigint, event_type string")


def _codelist(name: str, rows, code: str, title: str):
    """One codelist of the rows' distinct codes, in their order, as XML with prefixes."""
    codes = rows.select(F.col(code).cast("string").alias("code"), F.col(title).alias("title")).distinct().groupBy().agg(F.array_sort(F.collect_list(F.struct("code", "title"))).alias("c"))
    items = F.transform("c", lambda c: F.concat(F.lit('<str:Code id="'), c["code"], F.lit('"><com:Name xml:lang="en">'), c["title"], F.lit("</com:Name></str:Code>")))
    return codes.select(F.concat(F.lit(f'<str:Codelist id="{name}"><com:Name xml:lang="en">{name}</com:Name>'), F.array_join(items, ""), F.lit("</str:Codelist>")).alias("x"))


def _document(lists, dimensions: str = ""):
    """A structure message of codelists and a dataflow with its dimensions."""
    head = '<mes:Structure xmlns:mes="m" xmlns:str="s" xmlns:com="c"><str:Dataflow id="SHIPPED" agencyID="LSD"><com:Name xml:lang="en">Shipped amounts</com:Name></str:Dataflow><str:Codelists>'
    return lists.groupBy().agg(F.concat(F.lit(head), F.array_join(F.array_sort(F.collect_list("x")), ""), F.lit(f"</str:Codelists>{dimensions}</mes:Structure>")).alias("body"))


def _dimension(name: str, position: int, codes: str | None, kind: str = "Dimension") -> str:
    inner = f'<str:LocalRepresentation><str:Enumeration><Ref id="{codes}"/></str:Enumeration></str:LocalRepresentation>' if codes else "<str:LocalRepresentation/>"
    return f'<str:{kind} id="{name}" position="{position}">{inner}</str:{kind}>'


def _flow_document(t: Tables):
    shipped = t.lineitem.select("l_returnflag", "l_linestatus", F.concat(F.lit("flag "), "l_returnflag").alias("flag"), F.concat(F.lit("status "), "l_linestatus").alias("status"))
    lists = _codelist("CL_FLAG", shipped, "l_returnflag", "flag").unionByName(_codelist("CL_STATUS", shipped, "l_linestatus", "status"))
    return _document(lists, _dimension("flag", 1, "CL_FLAG") + _dimension("status", 2, "CL_STATUS") + _dimension("time", 3, None, "TimeDimension"))


@query("sdmx_decode", f"SELECT flow, left(series_id, 1) AS flag, right(series_id, 1) AS status, strftime(period_date, '%Y-%m') AS label, value, CASE month(period_date) % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'E' END AS quality, 'status ' || right(series_id, 1) AS status_name FROM ({PANEL}), (SELECT 'SHIPPED' AS flow)")
def sdmx_decode(spark, sf):
    """The monthly panel as messages, a flag each: the status has its values in the structure document alone, and each
    observation has an attribute's index."""
    t = Tables(spark, sf)
    p = panel(t).select(F.substring("series_id", 1, 1).alias("flag"), F.substring("series_id", 2, 1).alias("status"), F.date_format("period_date", "yyyy-MM").alias("label"), F.month("period_date").alias("month"), "value")
    labels = p.groupBy("flag").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    codes = p.groupBy(F.lit(1).alias("one")).agg(F.array_sort(F.collect_set("status")).alias("codes"))
    d = p.join(labels, "flag").withColumn("one", F.lit(1)).join(F.broadcast(codes), "one")
    index = lambda of, what: (F.array_position(of, F.col(what)) - 1).cast("string")
    cell = F.array(F.col("value").cast("string"), F.when(F.col("month") % 3 < 2, (F.col("month") % 3).cast("string")))
    series = d.groupBy("flag", "labels", index("codes", "status").alias("s")).agg(F.map_from_entries(F.collect_list(F.struct(index("labels", "label"), cell))).alias("observations"))
    whole = series.groupBy("flag", "labels").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("0:"), "s"), F.struct("observations")))).alias("series"))
    values = lambda of: F.transform(of, lambda v: F.struct(v.alias("id")))
    dimension = lambda name, of: F.struct(F.lit(name).alias("id"), values(of).alias("values"))
    none = F.array().cast("array<string>")
    dimensions = F.struct(F.array(dimension("flag", F.array("flag")), dimension("status", none)).alias("series"), F.array(dimension("time", F.col("labels"))).alias("observation"))
    attributes = F.struct(F.array(dimension("quality", F.array(F.lit("A"), F.lit("E")))).alias("observation"))
    body = F.to_json(F.struct(F.struct(dimensions.alias("dimensions"), attributes.alias("attributes")).alias("structure"), F.array(F.struct("series")).alias("dataSets")))
    document = _flow_document(t)
    out = sdmx.decode(whole.select(body.alias("body")), lists=sdmx.dimension_codes(document))
    out = out.select(*(F.col("dims")[c].alias(n) for c, n in (("flag", "flag"), ("status", "status"), ("time", "label"))), "value", F.col("attributes")["quality"].alias("quality"))
    names = sdmx.codelist(document).where("list_id = 'CL_STATUS'").select(F.col("code").alias("status"), F.col("name").alias("status_name"))
    flow = sdmx.structure(document).where("dimension = 'status'").select("flow", F.lit("CL_STATUS").alias("list"))
    return out.join(names, "status").withColumn("list", F.lit("CL_STATUS")).join(F.broadcast(flow), "list").drop("list")


@query("sdmx_codelist", "SELECT 'CL_NATION_' || r_regionkey AS list_id, CAST(n_nationkey AS VARCHAR) AS code, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey")
def sdmx_codelist(spark, sf):
    """A codelist of nations for each region, and back."""
    t = Tables(spark, sf)
    lists = None
    for key in range(5):
        own = _codelist(f"CL_NATION_{key}", t.nation.where(F.col("n_regionkey") == key), "n_nationkey", "n_name")
        lists = own if lists is None else lists.unionByName(own)
    return sdmx.codelist(_document(lists)).select("list_id", "code", "name")


@query("sdmx_structure", "SELECT * FROM (VALUES ('flag', 1, 'CL_FLAG'), ('status', 2, 'CL_STATUS'), ('time', 3, NULL)) d(dimension, position, list_id), (SELECT 'SHIPPED' AS flow, 'LSD' AS agency, 'Shipped amounts' AS title, count(DISTINCT l_returnflag) AS n_flags, count(DISTINCT l_linestatus) AS n_status FROM lineitem)")
def sdmx_structure(spark, sf):
    document = _flow_document(Tables(spark, sf))
    n = sdmx.codelist(document).groupBy(F.lit(1).alias("one")).agg(*(F.count_if(F.col("list_id") == x).alias(c) for x, c in (("CL_FLAG", "n_flags"), ("CL_STATUS", "n_status"))))
    return sdmx.structure(document).withColumn("one", F.lit(1)).join(F.broadcast(n), "one").drop("one")


@query("long_datasets", "SELECT CAST(n_nationkey AS INTEGER) AS dataset, n_name AS name, min(CAST(o_orderdate AS DATE)) AS earliest FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE n_regionkey IN (1, 2, 3) GROUP BY ALL HAVING min(CAST(o_orderdate AS DATE)) <= DATE '1995-02-01' ORDER BY earliest, dataset LIMIT 12")
def long_datasets(spark, sf):
    """Nations of three regions as datasets: eligible by the catalogue, then by their files' earliest dates; the top 12."""
    t = Tables(spark, sf)
    at = f"{sinks.scratch(spark)}/datasets-{uuid.uuid4().hex}"
    d = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").cast("int").alias("dataset"), F.col("o_orderdate").cast("date").alias("period_date"), "o_totalprice")
    d.repartition("dataset").write.partitionBy("dataset").parquet(at)
    eligible = t.nation.where("n_regionkey in (1, 2, 3)").select(F.col("n_nationkey").cast("int").alias("dataset"), F.col("n_name").alias("name"))
    return files.long_datasets(eligible, files.earliest_dates(spark, at), "1995-02-01", 12).select("dataset", "name", "earliest")


def _page(number: int) -> str:
    return json.dumps({"result": {"items": [{"k": 10 * number + i, "v": None if i == 1 else i / 4} for i in range(3 if number < 4 else 1)]}})


@query("paged_source", "SELECT CAST(10 * p + i AS VARCHAR) AS k, CASE WHEN i <> 1 THEN CAST(i / 4 AS VARCHAR) END AS v FROM (SELECT unnest([1, 2, 3, 4]) AS p), (SELECT unnest([0, 1, 2]) AS i) WHERE p < 4 OR i = 0")
def paged_query(spark, sf):
    spark.dataSource.register(paged.paged_source("palimpsest_pages", _page, 4, ["result", "items"], ["k", "v"]))
    return spark.read.format("palimpsest_pages").load()


ROW_GROUP = 8 << 20


def _folder(spark) -> str:
    return f"{sinks.scratch(spark)}/stream-{uuid.uuid4().hex}"


@query("stream_append", f"SELECT series_id, period_date, event_type, count(*) AS n FROM (SELECT DISTINCT series_id, period_date, event_type FROM ({REVISED})) GROUP BY 1, 2, 3")
def stream_append(spark, sf):
    """Four files of events, one to a micro-batch; their row groups are small, so that a large file is read by many tasks."""
    at = _folder(spark)
    revised(Tables(spark, sf)).repartition(4, "event_id").write.option("parquet.block.size", ROW_GROUP).parquet(f"{at}/in")
    source = spark.readStream.schema(spark.read.parquet(f"{at}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    key = ["series_id", "period_date", "event_type"]
    for run in (1, 2):  # the second start finds nothing new
        ingest.stream_append(source, f"{at}/store", f"{at}/marks{run}", key, "event_id").awaitTermination()
    return spark.read.parquet(f"{at}/store").groupBy(*key).agg(F.count(F.lit(1)).alias("n"))


@query("stream_daily_state", f"SELECT series_id, period_date, count(*) AS n_revisions FROM ({REVISED}) WHERE period_date <= DATE '2024-01-20' GROUP BY 1, 2")
def stream_daily_state(spark, sf):
    at = _folder(spark)
    revised(Tables(spark, sf)).withColumn("observed_at", F.col("observed_at").cast("timestamp")).orderBy("observed_at").write.parquet(f"{at}/in")
    source = ingest.read_stream(spark, f"{at}/in", spark.read.parquet(f"{at}/in").schema)
    ingest.run_to_table(ingest.daily_state(source), f"{at}/out", f"{at}/marks").awaitTermination()
    out = spark.read.schema("series_id long, window struct<start:timestamp,end:timestamp>, n_revisions long, last_value double").parquet(f"{at}/out")
    return out.select("series_id", F.col("window.start").cast("date").alias("period_date"), "n_revisions").where("period_date <= date'2024-01-20'")
