"""SDMX-JSON cubes: index-coded observations turned into rows of dimension values, with column expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VALUE = "struct<id:string,name:string>"
DIMENSION = f"struct<id:string,values:array<{VALUE}>>"
OBS = "map<string,array<string>>"
MESSAGE = f"struct<structure:struct<dimensions:struct<series:array<{DIMENSION}>,observation:array<{DIMENSION}>>,attributes:struct<observation:array<{DIMENSION}>>>,dataSets:array<struct<series:map<string,struct<observations:{OBS}>>,observations:{OBS}>>>"


def decode(messages: DataFrame, column: str = "body", *keep: str, lists: DataFrame | None = None) -> DataFrame:
    """keep, dims (map of dimension id to value id), value and attributes (map of id to value id) of every observation.

    Both layouts are read: observations under series (key of series and of observation) and flat ones. A key longer
    than its dimensions uses the last parts; shorter keys are skipped, as are indexes beyond a dimension's values. An
    observation's numbers after the first are indexes of its attributes' values, null where there is none. Dimensions
    whose message lists no values take those of lists (dimension, codes in order).
    """
    m = messages.select(*keep, F.from_json(column, MESSAGE).alias("m"))
    none = F.array().cast(f"array<{DIMENSION}>")
    of = lambda name: F.coalesce(f"m.structure.{name}", none)
    m = m.select(*keep, of("dimensions.series").alias("ds"), of("dimensions.observation").alias("do"), of("attributes.observation").alias("at"), F.explode("m.dataSets").alias("set"))
    if lists is not None:
        # One map of all lists beside every message: structure documents are small.
        known = lists.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("dimension", "codes"))).alias("lists"))
        m = m.withColumn("one", F.lit(1)).join(F.broadcast(known.withColumn("one", F.lit(1))), "one", "left").drop("one")

        def completed(d):
            codes = F.transform(F.try_element_at("lists", d["id"]), lambda c: F.struct(c.alias("id"), F.lit(None).cast("string").alias("name")))
            return F.struct(d["id"].alias("id"), F.when(F.coalesce(F.size(d["values"]), F.lit(0)) > 0, d["values"]).otherwise(codes).alias("values"))

        m = m.withColumns({c: F.transform(c, completed) for c in ("ds", "do")}).drop("lists")
    nested = m.where("set.series is not null").select(*keep, "at", F.concat("ds", "do").alias("d"), F.explode("set.series").alias("sk", "s")).select(*keep, "at", "d", "sk", F.explode("s.observations").alias("ok", "v"))
    nested = nested.select(*keep, "at", "d", F.concat_ws(":", "sk", "ok").alias("key"), "v")
    flat = m.where("set.observations is not null").select(*keep, "at", F.concat("ds", "do").alias("d"), F.explode("set.observations").alias("key", "v"))
    rows = nested.unionByName(flat).withColumn("i", F.split("key", ":")).where(F.size("i") >= F.size("d"))
    rows = rows.withColumn("i", F.slice("i", F.size("i") - F.size("d") + 1, F.size("d")))
    at = lambda d, i: F.try_element_at(d["values"], i.try_cast("int") + 1)["id"]
    rows = rows.withColumn("pairs", F.zip_with("d", "i", lambda d, i: F.struct(d["id"].alias("key"), at(d, i).alias("value"))))
    rows = rows.where(~F.exists("pairs", lambda p: p["value"].isNull()))
    attributes = F.transform("at", lambda a, k: F.struct(a["id"].alias("key"), at(a, F.try_element_at("v", k + 2)).alias("value")))
    return rows.select(*keep, F.map_from_entries("pairs").alias("dims"), F.try_element_at("v", F.lit(1)).try_cast("double").alias("value"), F.map_from_entries(attributes).alias("attributes"))


def _plain(column: str):
    """XML without namespace prefixes and declarations."""
    return F.regexp_replace(F.regexp_replace(column, r"<(/?)[A-Za-z0-9]+:", "<$1"), r"\sxmlns(:\w+)?=\"[^\"]*\"", "")


def structure(documents: DataFrame, column: str = "body") -> DataFrame:
    """flow, agency, title, dimension, position, list_id of the data structure in SDMX structure XML."""
    x = documents.select(_plain(column).alias("x"))
    flow = lambda what: F.regexp_extract("x", rf'<Dataflow[^>]*\b{what}="([^"]*)"', 1).alias
    title = F.regexp_extract("x", r"(?s)<Dataflow\b[^>]*>\s*<Name[^>]*>([^<]*)</Name>", 1).alias("title")
    d = x.select(flow("id")("flow"), flow("agencyID")("agency"), title, F.explode(F.expr(r"regexp_extract_all(x, '(?s)<(?:Time)?Dimension\\b.*?</(?:Time)?Dimension>', 0)")).alias("d"))
    of = lambda pattern: F.regexp_extract("d", pattern, 1)
    listed = of(r'(?s)<Enumeration>.*?<Ref[^>]*\bid="([^"]*)"')
    return d.select("flow", "agency", "title", of(r'Dimension[^>]*\bid="([^"]*)"').alias("dimension"), of(r'Dimension[^>]*\bposition="(\d+)"').try_cast("int").alias("position"), F.when(listed != "", listed).alias("list_id"))


def dimension_codes(documents: DataFrame, column: str = "body") -> DataFrame:
    """dimension, codes: each dimension's codes in the order of its codelist, for decode."""
    codes = codelist(documents, column).groupBy("list_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "code"))), lambda c: c["code"]).alias("codes"))
    return structure(documents, column).join(codes, "list_id").select("dimension", "codes")


def codelist(documents: DataFrame, column: str = "body") -> DataFrame:
    """list_id, code, name, position (from 0) of the codelists in SDMX structure XML, whatever its namespace prefixes."""
    lists = documents.select(_plain(column).alias("x")).select(F.explode(F.expr(r"regexp_extract_all(x, '(?s)<Codelist\\b.*?</Codelist>', 0)")).alias("l"))
    codes = lists.select(F.regexp_extract("l", r'<Codelist[^>]*\bid="([^"]*)"', 1).alias("list_id"), F.posexplode(F.expr(r"regexp_extract_all(l, '(?s)<Code\\b.*?</Code>', 0)")).alias("position", "c"))
    return codes.select("list_id", F.regexp_extract("c", r'<Code[^>]*\bid="([^"]*)"', 1).alias("code"), F.xpath_string(F.regexp_replace("c", r"\s\w+:\w+=\"[^\"]*\"", ""), F.lit("/Code/Name[1]")).alias("name"), "position")
