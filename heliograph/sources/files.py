"""Tab-separated event, mention and article files, gazetteers, country tables and the names of file series.

Lines are read as text where a row's own width says whether it is good: a CSV reader would pad short rows.
Timestamps are UTC.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph import schemas
from heliograph.functions import empty_to_null

#: Places (from 0) of the event file's columns that are read; the file has WIDTH columns.
WIDTH = 61
AT = {"external_id": 0, "day": 1, "actor1_name": 6, "actor1_country": 7, "actor2_name": 16, "actor2_country": 17, "cameo_code": 26, "cameo_root": 28, "quad_class": 29, "goldstein": 30, "num_mentions": 31, "num_sources": 32, "num_articles": 33, "tone": 34, "geo_type": 51, "geo_name": 52, "country": 53, "adm1": 54, "lat": 56, "lon": 57, "added_at": 59, "url": 60}
STAMP = "yyyyMMddHHmmss"


def fields(lines: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    return lines.select(*also, F.split("value", "\t", -1).alias("f"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def event_rows(lines: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """All event rows with `kept`: of full width, with a place, its country and coordinates. A bad day is null. Columns `also` stay."""
    f = lambda name: F.get(F.col("f"), F.lit(AT[name]))
    text = lambda name: empty_to_null(f(name)).alias(name)
    number = lambda name, kind: f(name).try_cast(kind).alias(name)
    rows = fields(lines, also).select(
        *also, "f", text("external_id"), F.to_date(F.try_to_timestamp(f("day"), F.lit("yyyyMMdd"))).alias("occurred_on"), F.try_to_timestamp(f("added_at"), F.lit(STAMP)).alias("added_at"), text("cameo_code"), text("cameo_root"),
        number("quad_class", "short"), number("goldstein", "double"), number("tone", "double"), *(text(c) for c in ("actor1_name", "actor1_country", "actor2_name", "actor2_country")), number("geo_type", "short"), text("geo_name"), text("country"), text("adm1"),
        number("lon", "double"), number("lat", "double"), *(number(c, "int") for c in ("num_mentions", "num_sources", "num_articles")), text("url"), F.lit(None).cast("string").alias("props"),
    )
    kept = (F.size("f") == WIDTH) & ~F.coalesce(f("geo_type"), F.lit("")).isin("", "0") & F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("country").isNotNull()
    return rows.withColumn("kept", F.coalesce(kept, F.lit(False))).drop("f")


def events(lines: DataFrame) -> DataFrame:
    return event_rows(lines).filter("kept").drop("kept")


def mention_rows(lines: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """All mention rows with `kept`: at least 14 columns, an event, a time and an outlet."""
    f = lambda i: F.get(F.col("f"), F.lit(i))
    rows = fields(lines, also).select(*also, F.size("f").alias("n"), empty_to_null(f(0)).alias("event_id"), F.try_to_timestamp(f(2), F.lit(STAMP)).alias("mentioned_at"), empty_to_null(f(4)).alias("source_name"))
    good = (F.col("n") >= 14) & F.col("event_id").isNotNull() & F.col("mentioned_at").isNotNull() & F.col("source_name").isNotNull()
    return rows.withColumn("kept", good).drop("n")


def mentions(lines: DataFrame, event: DataFrame) -> DataFrame:
    """Mentions of known events; event has id and external_id."""
    good = mention_rows(lines).filter("kept").select(F.col("event_id").alias("external_id"), "mentioned_at", "source_name")
    return good.join(event.select("id", "external_id"), "external_id").select(F.col("id").alias("event_id"), "mentioned_at", "source_name")


def theme_list(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, ";"), lambda x: x != ""))


PLACE = "struct<loc_type: short, country: string, adm1: string, lon: double, lat: double>"


def place_list(c: Column) -> Column:
    """Places of an article, each once: with country and coordinates; adm1 only where it says more than the country."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.split(x, "#"))

    def one(p: Column) -> Column:
        country, adm1 = empty_to_null(F.get(p, F.lit(2))), empty_to_null(F.get(p, F.lit(3)))
        kind = F.get(p, F.lit(0)).try_cast("short")
        return F.struct(kind.alias("loc_type"), country.alias("country"), F.when((kind != 1) & (adm1 != country), adm1).alias("adm1"), F.get(p, F.lit(5)).try_cast("double").alias("lon"), F.get(p, F.lit(4)).try_cast("double").alias("lat"))

    made = F.transform(F.filter(parts, lambda p: F.size(p) >= 6), one)
    return F.array_distinct(F.filter(made, lambda p: p["country"].isNotNull() & p["lat"].isNotNull() & p["lon"].isNotNull()))


def articles(lines: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """Articles with their themes and places; rows of less than 16 columns or without id, time, site or link are no articles."""
    f = lambda i: F.get(F.col("f"), F.lit(i))
    tone = F.get(F.split(f(15), ","), F.lit(0)).try_cast("double")
    rows = fields(lines, also).filter(F.size("f") >= 16).select(*also, empty_to_null(f(0)).alias("gkg_id"), F.try_to_timestamp(f(1), F.lit(STAMP)).alias("added_at"), empty_to_null(f(4)).alias("url"), empty_to_null(f(3)).alias("site"), tone.alias("tone"), theme_list(f(7)).alias("themes"), place_list(f(9)).alias("places"))
    return rows.filter("gkg_id is not null and added_at is not null and site is not null and url is not null")


def article_places(rows: DataFrame) -> DataFrame:
    return rows.select("gkg_id", F.explode("places").alias("p")).select("gkg_id", "p.*")


def series_slots(spark: SparkSession, since: str, until: str, suffix: str) -> DataFrame:
    """Names of a file series' quarter-hour files from since's quarter to until's."""
    step = "sequence(timestamp_ntz '{}', timestamp_ntz '{}', interval 15 minutes)"
    floor = lambda x: f"{x[:14]}{int(x[14:16]) // 15 * 15:02d}:00"
    return spark.range(1).select(F.explode(F.expr(step.format(floor(since), floor(until)))).alias("slot")).select("slot", F.concat(F.date_format("slot", STAMP), F.lit(suffix)).alias("file"))


def gazetteer(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Places of a tab-separated gazetteer: id, name, alternates, iso2, admin1, lat, lon, population."""
    ddl = "id long, name string, alternates string, iso2 string, admin1 string, lat double, lon double, population long"
    return spark.read.schema(ddl).option("sep", "\t").option("quote", "").csv(path).withColumn("kind", F.lit(kind))


def country_codes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TABLES["country_code"]).option("sep", "\t").option("comment", "#").csv(path)


POLYGON = "array<array<array<double>>>"


def country_shapes(spark: SparkSession, path: str) -> DataFrame:
    """Shapes of a feature collection; features of one code are parts of one shape."""
    ddl = "features array<struct<properties: struct<fips: string, name: string>, geometry: struct<type: string, coordinates: string>>>"
    f = spark.read.schema(ddl).option("multiLine", True).json(path).select(F.explode("features").alias("f")).select("f.properties.*", "f.geometry.*")
    polygons = F.when(F.col("type") == "Polygon", F.array(F.from_json("coordinates", POLYGON))).otherwise(F.from_json("coordinates", f"array<{POLYGON}>"))
    named = f.select("fips", "name", F.transform(polygons, lambda p: F.transform(p, lambda ring: F.transform(ring, lambda v: F.struct(v[0].alias("x"), v[1].alias("y"))))).alias("part"))
    return named.groupBy("fips").agg(F.min("name").alias("name"), F.flatten(F.collect_list("part")).alias("geom"))


def manual_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("country string, name string, kind string, value string").option("header", True).option("comment", "#").csv(path).withColumn("origin", F.lit("manual"))
