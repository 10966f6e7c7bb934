"""Feeds that are polled: every answer ever landed is a file, and a job parses them all and keeps the latest of
each key. All end in the event columns, the source's own fields as JSON in `props`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph import schemas
from heliograph.functions import all_fields_json, empty_to_null, human_count, plain_text, unescaped

EVENT_COLUMNS = [c.split()[0] for c in schemas.EVENT.split(", ")]
KINDS = dict(c.split() for c in schemas.EVENT.split(", "))


def as_events(rows: DataFrame) -> DataFrame:
    """rows with all event columns, null where a source has none, '' for an unknown country."""
    have = {c: F.col(c) for c in rows.columns}
    have.setdefault("country", F.lit(""))
    have.setdefault("occurred_on", F.to_date("added_at"))
    return rows.select(*(have.get(c, F.lit(None)).cast(KINDS[c]).alias(c) for c in EVENT_COLUMNS))


def latest(rows: DataFrame, key: str, order: str | Column) -> DataFrame:
    """The newest row of each key."""
    o = F.col(order) if isinstance(order, str) else order
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), o).alias("r")).select("r.*")


def json_file(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).option("multiLine", True).json(path)


def quakes(spark: SparkSession, path: str) -> DataFrame:
    """Quakes of feature collections; without magnitude or place they are none."""
    ddl = "features array<struct<id: string, properties: struct<mag: double, place: string, time: long, updated: long, url: string, alert: string, tsunami: int, sig: int, title: string>, geometry: struct<coordinates: array<double>>>>"
    f = json_file(spark, path, ddl).select(F.explode("features").alias("f")).select("f.id", "f.properties.*", F.col("f.geometry.coordinates").alias("c")).filter((F.size("c") >= 2) & F.col("mag").isNotNull())
    e = f.select(F.col("id").alias("external_id"), F.timestamp_millis("time").alias("added_at"), F.col("place").alias("geo_name"), F.col("c")[0].alias("lon"), F.col("c")[1].alias("lat"), "url", all_fields_json(F.lit("earthquake").alias("kind"), "title", "mag", F.get("c", F.lit(2)).alias("depth_km"), "alert", F.coalesce(F.col("tsunami") != 0, F.lit(False)).alias("tsunami"), "sig", F.timestamp_millis("updated").alias("updated")).alias("props"), "updated")
    return as_events(latest(e, "external_id", "updated"))


def rfc_time(c: Column) -> Column:
    return F.try_to_timestamp(F.substring_index(c, ", ", -1), F.lit("dd MMM yyyy HH:mm:ss z"))


def disasters(spark: SparkSession, path: str) -> DataFrame:
    """Disaster alerts of RSS items with a point `lat lon`."""
    severity = "struct<_value: double, _unit: string, txt: string>"
    ddl = f"title string, link string, pubDate string, `gdacs:dateadded` string, `gdacs:datemodified` string, `gdacs:iscurrent` string, `gdacs:fromdate` string, `gdacs:eventtype` string, `gdacs:alertlevel` string, `gdacs:alertscore` double, `gdacs:eventid` string, `gdacs:episodeid` string, `gdacs:severity` {severity}, `gdacs:iso3` string, `gdacs:country` string, `georss:point` string"
    r = spark.read.format("xml").option("rowTag", "item").option("valueTag", "txt").schema(ddl).load(path)
    g = lambda c: F.col(f"`gdacs:{c}`")
    point = F.split(F.trim(F.col("`georss:point`")), "\\s+")
    e = r.select(F.concat(g("eventtype"), g("eventid")).alias("external_id"), F.coalesce(rfc_time(g("dateadded")), rfc_time(F.col("pubDate"))).alias("added_at"), F.to_date(F.coalesce(rfc_time(g("fromdate")), rfc_time(g("dateadded")), rfc_time(F.col("pubDate")))).alias("occurred_on"), empty_to_null(g("country")).alias("geo_name"), F.get(point, F.lit(1)).try_cast("double").alias("lon"), F.get(point, F.lit(0)).try_cast("double").alias("lat"), F.col("link").alias("url"), all_fields_json(g("eventtype").alias("event_type"), "title", g("alertlevel").alias("alert"), g("alertscore").alias("alert_score"), g("episodeid").alias("episode"), g("iso3").alias("iso3"), g("severity")["txt"].alias("severity"), g("severity")["_value"].alias("severity_value"), (g("iscurrent") == "true").alias("current"), F.coalesce(rfc_time(g("datemodified")), rfc_time(g("dateadded")), rfc_time(F.col("pubDate"))).alias("modified")).alias("props"), rfc_time(g("datemodified")).alias("changed"))
    return as_events(latest(e.filter("external_id is not null and added_at is not null and lon is not null and lat is not null"), "external_id", F.coalesce("changed", "added_at")))


def weather_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Weather alerts with their zones, references and own shape, still to be placed."""
    props = "id: string, areaDesc: string, sent: timestamp, effective: timestamp, onset: timestamp, expires: timestamp, ends: timestamp, severity: string, urgency: string, certainty: string, event: string, messageType: string, headline: string, affectedZones: array<string>, references: array<struct<identifier: string>>"
    f = json_file(spark, path, f"features array<struct<geometry: struct<type: string, coordinates: array<array<array<double>>>>, properties: struct<{props}>>>").select(F.explode("features").alias("f"))
    rings = F.transform("f.geometry.coordinates", lambda ring: F.transform(ring, lambda v: F.struct(v[0].alias("x"), v[1].alias("y"))))
    p = f.select(F.when(F.col("f.geometry").isNotNull(), F.array(rings)).alias("geom"), "f.properties.*")
    return p.select(F.col("id").alias("external_id"), F.coalesce("onset", "effective", "sent").alias("added_at"), F.substring("areaDesc", 1, 300).alias("geo_name"), "geom", F.col("affectedZones").alias("zones"), F.transform("references", lambda r: r["identifier"]).alias("refs"), all_fields_json("severity", "urgency", "certainty", "event", F.col("messageType").alias("message_type"), "headline", "expires", "ends").alias("props"))


def zones(spark: SparkSession, path: str) -> DataFrame:
    f = json_file(spark, path, "url string, type string, id string, name string, geometry struct<type: string, coordinates: array<array<array<double>>>>")
    return f.select("url", F.col("id").alias("code"), F.col("type").alias("kind"), "name", F.array(F.transform("geometry.coordinates", lambda ring: F.transform(ring, lambda v: F.struct(v[0].alias("x"), v[1].alias("y"))))).alias("geom"))


def tsunami_bulletins(spark: SparkSession, path: str) -> DataFrame:
    """Atom bulletins; category and magnitude stand in the summary's markup."""
    r = spark.read.format("xml").option("rowTag", "entry").schema("id string, title string, updated timestamp, `geo:lat` double, `geo:long` double, summary string").load(path)
    said = lambda label: empty_to_null(F.trim(F.regexp_extract(F.regexp_replace("summary", "<[^>]+>", " "), f"(?i){label}\\s*:\\s*([^\\s]+)", 1)))
    e = r.select(F.col("id").alias("external_id"), F.col("updated").alias("added_at"), F.col("title").alias("geo_name"), F.col("`geo:long`").alias("lon"), F.col("`geo:lat`").alias("lat"), all_fields_json(said("Category").alias("category"), F.regexp_extract(F.coalesce(said("Preliminary Magnitude"), F.lit("")), "^[0-9.]+", 0).try_cast("double").alias("magnitude")).alias("props"))
    return as_events(latest(e.filter("lon is not null and lat is not null"), "external_id", "added_at"))


def volcanoes(spark: SparkSession, path: str, as_of: Column) -> DataFrame:
    """Elevated volcanoes; each change of colour is an event of its own."""
    v = json_file(spark, path, "vnum string, vName string, lat double, long double, colorCode string, alertLevel string, colorCodePrev string, alertLevelPrev string, codeChangeDate string, noticeSynopsis string, noticeUrl string, nvewsThreat string, obs string")
    at = F.try_to_timestamp("codeChangeDate", F.lit("yyyy-MM-dd HH:mm:ss"))
    e = v.select(F.concat_ws(":", "vnum", F.date_format(at, "yyyyMMddHHmmss")).alias("external_id"), at.alias("added_at"), F.col("vName").alias("geo_name"), F.col("long").alias("lon"), "lat", F.col("noticeUrl").alias("url"), all_fields_json(F.col("colorCode").alias("color"), F.col("alertLevel").alias("level"), F.col("colorCodePrev").alias("color_before"), F.date_format(as_of, "yyyy-MM-dd HH:mm:ss").alias("seen"), F.col("noticeSynopsis").alias("synopsis")).alias("props"))
    return as_events(e.filter("added_at is not null"))


def fire_pixels(spark: SparkSession, path: str, satellite: str) -> DataFrame:
    """Detections of a satellite's CSV; rows with a bad time or place are none."""
    ddl = "latitude string, longitude string, bright_ti4 string, scan string, track string, acq_date string, acq_time string, satellite string, confidence string, version string, bright_ti5 string, frp string, daynight string"
    at = F.try_to_timestamp(F.concat_ws(" ", "acq_date", F.lpad("acq_time", 4, "0")), F.lit("yyyy-MM-dd HHmm"))
    r = spark.read.schema(ddl).option("header", True).csv(path)
    d = r.select(F.lit(satellite).alias("satellite"), F.col("latitude").try_cast("double").alias("lat"), F.col("longitude").try_cast("double").alias("lon"), at.alias("acq_at"), F.col("frp").try_cast("double").alias("frp"), "confidence", "daynight", F.col("bright_ti4").try_cast("double").alias("bright_ti4"))
    return d.filter("lat is not null and lon is not null and acq_at is not null and frp is not null").dropDuplicates(["satellite", "lat", "lon", "acq_at"])


def outages(spark: SparkSession, path: str) -> DataFrame:
    """Measured outages of countries and regions; those of networks are left out."""
    d = json_file(spark, path, "data array<struct<location: string, start: long, duration: long, method: string, datasource: string, score: double, location_name: string>>").select(F.explode("data").alias("d")).select("d.*")
    p = d.select("*", F.split("location", "/")[0].alias("kind"), F.get(F.split("location", "/"), F.lit(1)).alias("code")).filter(F.col("kind").isin("country", "region"))
    return p.select(F.concat_ws(":", "location", "start", "datasource").alias("external_id"), "kind", "code", F.timestamp_seconds("start").alias("added_at"), F.col("location_name").alias("geo_name"), all_fields_json(F.timestamp_seconds(F.col("start") + F.coalesce("duration", F.lit(0))).alias("end"), "score", "method", "datasource").alias("props"))


def outage_notes(spark: SparkSession, path: str) -> DataFrame:
    """Annotated outages, one for each location."""
    a = "id: string, startDate: timestamp, endDate: timestamp, description: string, scope: string, linkedUrl: string, dataSource: string, locations: array<string>, locationsDetails: array<struct<code: string, name: string>>, asnsDetails: array<struct<name: string>>, outage: struct<outageCause: string, outageType: string>"
    r = json_file(spark, path, f"result struct<annotations: array<struct<{a}>>>").select(F.explode("result.annotations").alias("a")).select("a.*")
    names = F.map_from_entries(F.transform("locationsDetails", lambda d: F.struct(d["code"], d["name"])))
    return r.withColumn("code", F.explode("locations")).select(F.concat_ws(":", "id", "code").alias("external_id"), "code", F.col("startDate").alias("added_at"), F.element_at(names, F.col("code")).alias("geo_name"), F.col("linkedUrl").alias("url"), all_fields_json(F.col("endDate").alias("end"), "description", "scope", F.col("outage.outageCause").alias("cause"), F.col("outage.outageType").alias("type"), F.transform("asnsDetails", lambda x: x["name"]).alias("networks")).alias("props"))


def placed_codes(rows: DataFrame, codes: DataFrame, points: DataFrame) -> DataFrame:
    """rows with country and a point for their ISO code, through the code table; unknown ones are dropped."""
    known = codes.select(F.col("iso2").alias("code"), F.col("fips").alias("country")).join(points.select(F.col("fips").alias("country"), "lon", "lat"), "country")
    return as_events(rows.join(F.broadcast(known), "code"))


def release_order(name: Column) -> Column:
    """When a conflict file's data end: a monthly release counts after one that unites the months up to it."""
    many, month = F.regexp_extract_all(name, F.lit("(\\d+)"), F.lit(1)), F.regexp_extract(name, "v(\\d+)_0_(\\d+)", 2)
    year = F.regexp_extract(name, "v(\\d+)_", 1).try_cast("int")
    return F.when(month != "", F.struct(year.alias("year"), month.try_cast("int").alias("month"), F.lit(1).alias("monthly"))).otherwise(F.struct(year.alias("year"), F.try_element_at(many, F.lit(-1)).try_cast("int").alias("month"), F.lit(0).alias("monthly")))


def conflicts(spark: SparkSession, path: str) -> DataFrame:
    """Conflict events of all releases, the latest release of each; without id or place they are none."""
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).withColumn("release", F.regexp_extract(F.col("_metadata.file_path"), "GED[A-Za-z]*_(v[0-9]+(?:_[0-9]+)+)", 1))
    n = lambda c: F.col(c).try_cast("double")
    e = r.select(F.col("id").alias("external_id"), F.try_to_timestamp(F.substring("date_start", 1, 10), F.lit("yyyy-MM-dd")).alias("added_at"), F.col("where_coordinates").alias("geo_name"), n("longitude").alias("lon"), n("latitude").alias("lat"), all_fields_json(F.coalesce(n("best"), F.lit(0.0)).cast("int").alias("best"), n("high").cast("int").alias("high"), n("low").cast("int").alias("low"), "side_a", "side_b", "conflict_name").alias("props"), release_order(F.col("release")).alias("o"))
    return as_events(latest(e.filter("external_id is not null and lon is not null and lat is not null"), "external_id", "o"))


def newest_run(runs: DataFrame) -> DataFrame:
    """Of forecast runs named like model_2026_08_t01, the latest by year, month, model and iteration."""
    p = lambda i: F.regexp_extract("run", "^([a-z]+)(\\d*)_(\\d{4})_(\\d{2})_t(\\d+)$", i)
    order = F.struct(p(3).try_cast("int").alias("y"), p(4).try_cast("int").alias("m"), p(2).try_cast("int").alias("v"), p(5).try_cast("int").alias("t"))
    return runs.filter(p(3) != "").agg(F.max_by("run", order).alias("run"))


def forecasts(spark: SparkSession, path: str, run: str) -> DataFrame:
    d = json_file(spark, path, "data array<struct<isoab: string, year: int, month: int, main_mean: double, main_dich: double>>").select(F.explode("data").alias("d")).select("d.*")
    return d.select(F.lit(run).alias("run"), F.col("isoab").alias("iso3"), F.make_date("year", "month", F.lit(1)).alias("month"), F.col("main_mean").alias("fatalities"), F.col("main_dich").alias("p_any"))


EDIT_MESSAGE = "wiki string, server_name string, title string, namespace int, type string, user string, bot boolean, timestamp long, revision struct<new: long>"


def edit_rows(messages: DataFrame) -> DataFrame:
    """Edits and new pages of encyclopedia articles; users only as a hash. Messages become columns by `inline`: a filter on fields of a
    struct would have each message parsed again for each field it asks for."""
    d = messages.select(F.inline(F.array(F.from_json("value", EDIT_MESSAGE)))).filter((F.col("namespace") == 0) & F.col("type").isin("edit", "new") & F.col("server_name").endswith(".wikipedia.org"))
    return d.select("wiki", F.col("server_name").alias("server"), "title", F.timestamp_seconds("timestamp").alias("at"), F.substring(F.sha2("user", 256), 1, 12).alias("user_hash"), F.coalesce("bot", F.lit(False)).alias("bot"), (F.col("type") == "new").alias("created"), F.col("revision.new").alias("rev"))


POST_MESSAGE = "did string, time_us long, kind string, commit struct<collection: string, operation: string, rkey: string, record: struct<text: string>>"


def post_rows(messages: DataFrame) -> DataFrame:
    """Creations and deletions of posts."""
    d = messages.select(F.from_json("value", POST_MESSAGE).alias("d")).select("d.*").filter((F.col("kind") == "commit") & (F.col("commit.collection") == "app.bsky.feed.post") & F.col("commit.operation").isin("create", "delete"))
    return d.select(F.col("commit.operation").alias("op"), F.timestamp_micros("time_us").alias("at"), F.concat_ws("/", F.concat(F.lit("at://"), "did"), "commit.collection", "commit.rkey").alias("uri"), F.col("commit.record.text").alias("text"))


def channel_posts(pages: DataFrame) -> DataFrame:
    """Posts of channel preview pages (handle, html), oldest first within a page: a post begins at its data-post mark."""
    blocks = F.filter(F.split("html", "data-post=\""), lambda _, i: i > 0)
    p = pages.select("handle", F.explode(blocks).alias("b"))
    first = lambda pattern: empty_to_null(F.regexp_extract("b", pattern, 1))
    body = F.regexp_extract("b", "(?s)class=\"[^\"]*message_text[^\"]*\"[^>]*>(.*?)</div>", 1)
    media = F.array_compact(F.array(*(F.when(F.col("b").contains(mark), kind) for mark, kind in (("message_photo", "photo"), ("message_video", "video"), ("message_document", "document"), ("message_voice", "voice")))))
    return p.select("handle", F.regexp_extract("b", "^[^\"/]+/(\\d+)", 1).try_cast("long").alias("post_id"), F.try_to_timestamp(first("datetime=\"([^\"]+)\"")).alias("posted_at"), empty_to_null(plain_text(body)).alias("text"), human_count(first("message_views\">([^<]+)<")).alias("views"), first("forwarded_from_name\"[^>]*>(?:<[^>]+>)?([^<]+)").alias("forward"), F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit("href=\"(https?://[^\"]+)\""), F.lit(1)), lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))).alias("links"), media.alias("media")).filter("post_id is not null")


def videos(listed: DataFrame, details: DataFrame) -> DataFrame:
    """Videos of landed lists, with their landed detail where there is one; upcoming ones are left out, and the
    list's time holds before the detail's."""
    d = details.select("video_id", "description", "keywords", F.col("views").alias("d_views"), F.col("published").alias("d_published"))
    j = listed.filter(~F.coalesce("upcoming", F.lit(False))).join(d, "video_id", "left")
    return j.select("video_id", "title", F.coalesce("published", "d_published").alias("published"), F.greatest("views", "d_views").alias("views"), "length_s", "description", F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"), F.lit("live").alias("status"))


OUTLETS = "array<struct<sr: string, countries: array<struct<country: string, outlets: array<struct<outlet: string, assets: string, t: array<string>>>>>>>"


def outlet_pages(pages: DataFrame) -> DataFrame:
    """Outlets of the JSON that registry pages (html) hold in a script; a missing year is '-'."""
    data = F.from_json(F.regexp_extract("html", "(?s)const DATA\\s*=\\s*(\\[.*?\\]);", 1), OUTLETS)
    c = pages.select(F.explode(data).alias("r")).select(F.explode("r.countries").alias("c")).select("c.country", F.explode("c.outlets").alias("o"))
    return c.select("country", F.col("o.outlet").alias("name"), F.col("o.assets").alias("assets"), F.transform("o.t", lambda x: F.coalesce(x, F.lit("-"))).alias("trajectory"))


def outlet_profiles(pages: DataFrame, first: int = 2022, last: int = 2026) -> DataFrame:
    """Outlets of profile cards (title, html): country, kind, and a kind for each year, '-' where none is given."""
    label = lambda name: empty_to_null(F.trim(unescaped(F.regexp_extract("html", f"(?is){name}\\s*</[^>]+>\\s*<[^>]+>([^<]+)<", 1))))
    years = F.map_from_arrays(F.regexp_extract_all("html", F.lit("(20\\d\\d)\\s*:\\s*([A-Z]+)"), F.lit(1)), F.regexp_extract_all("html", F.lit("(20\\d\\d)\\s*:\\s*([A-Z]+)"), F.lit(2)))
    return pages.withColumn("years", years).select(label("Country").alias("country"), F.trim("title").alias("name"), label("Typology").alias("typology"), F.transform(F.sequence(F.lit(first), F.lit(last)), lambda y: F.coalesce(F.element_at("years", y.cast("string")), F.lit("-"))).alias("trajectory"))
