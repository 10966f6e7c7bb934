"""Queries over landed files: the driver's tables are written in a feed's format to the shared folder, read by that feed's
reader, and must come back as SQL has them from the tables. Also the archive, streams and places that move."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph import streaming
from heliograph.operators import archive, geo, registry
from heliograph.shared import new_folder
from heliograph.sources import files, snapshots

from . import standins as t
from .standins import at, stamp

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def land(rows: DataFrame, name: str, by: str | None = None) -> str:
    """The lines of rows (column value) as text files of a new folder; with `by`, of which each row has its own value, a file a row."""
    path = new_folder(rows.sparkSession, name)
    (rows.drop(by).write.option("maxRecordsPerFile", 1) if by else rows.write).text(path)
    return path


#: Keys that share one landed document, so that the number of documents follows the rows.
IN_ONE = 1000


def documents_of(rows: DataFrame, item: Column, head: str, foot: str, by: Column) -> DataFrame:
    """One text for each value of by: its items between head and foot."""
    return rows.groupBy(by.cast("string").alias("part")).agg(F.concat(F.lit(head), F.array_join(F.collect_list(item), ","), F.lit(foot)).alias("value"))


def compact(c: Column | str) -> Column:
    return F.date_format(c, "yyyyMMddHHmmss")


EVENT_ROWS = """SELECT event_id::VARCHAR AS external_id, strftime(ts, '%Y-%m-%d') AS occurred_on, strftime(ts, '%Y-%m-%d %H:%M:%S') AS added_at, 'NATION_' || (user_id % 25) AS country, (user_id % 90)::DOUBLE AS lat, -(event_id % 180)::DOUBLE AS lon, (event_id % 50)::INT AS num_mentions, 'http://e.example.org/' || event_id AS url
FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0"""


def event_lines(spark, d) -> DataFrame:
    """Events as rows of the 61-column file; every fifth has no place, every seventh is a column short."""
    e = t.table(spark, d, "events")
    own = {"external_id": F.col("event_id").cast("string"), "day": F.date_format("ts", "yyyyMMdd"), "num_mentions": (F.col("event_id") % 50).cast("string"), "geo_type": F.when(F.col("event_id") % 5 == 0, "0").otherwise("4"), "geo_name": F.lit('A "quoted place'), "country": F.concat(F.lit("NATION_"), F.col("user_id") % 25), "lat": (F.col("user_id") % 90).cast("string"), "lon": (-(F.col("event_id") % 180)).cast("string"), "added_at": compact("ts"), "url": F.concat(F.lit("http://e.example.org/"), "event_id")}
    at_place = {files.AT[k]: v for k, v in own.items()}
    line = F.array(*(at_place.get(i, F.lit("")) for i in range(files.WIDTH)))
    return e.select(F.concat_ws("\t", F.when(F.col("event_id") % 7 == 0, F.slice(line, 1, files.WIDTH - 1)).otherwise(line)).alias("value"))


@query("s02_event_files", EVENT_ROWS)
def s02(spark, d):
    e = files.events(files.read_lines(spark, land(event_lines(spark, d), "events")))
    return e.select("external_id", F.col("occurred_on").cast("string").alias("occurred_on"), stamp("added_at").alias("added_at"), "country", "lat", "lon", "num_mentions", "url")


@query("t08_event_file_stream", EVENT_ROWS)
def t08(spark, d):
    """The same files as a stream, a micro-batch a file."""
    out, cp = new_folder(spark, "series"), new_folder(spark, "series-checkpoint")
    streaming.load_series(spark, land(event_lines(spark, d), "events"), out, cp)
    e = spark.read.parquet(f"{out}/batch=*")
    return e.select("external_id", F.col("occurred_on").cast("string").alias("occurred_on"), stamp("added_at").alias("added_at"), "country", "lat", "lon", "num_mentions", "url")


@query("s03_mention_files", """SELECT c_custkey AS event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS mentioned_at, 'k' || json_extract_string(props, '$.k') AS source_name
FROM events JOIN customer ON user_id = c_custkey WHERE event_id % 6 <> 0 AND c_custkey % 4 <> 0""")
def s03(spark, d):
    """Mentions of known events; every sixth line is too short, and every fourth event is not known."""
    e = t.table(spark, d, "events")
    full = F.array(F.col("user_id").cast("string"), F.lit(""), compact("ts"), F.lit("1"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")), *(F.lit("x") for _ in range(11)))
    lines = e.select(F.concat_ws("\t", F.when(F.col("event_id") % 6 == 0, F.slice(full, 1, 10)).otherwise(full)).alias("value"))
    known = t.table(spark, d, "customer").filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_custkey").cast("string").alias("external_id"))
    return files.mentions(files.read_lines(spark, land(lines, "mentions")), known).withColumn("mentioned_at", stamp("mentioned_at"))


ARTICLE_CELLS = "SELECT o_orderkey, o_custkey, o_orderpriority, o_orderdate, 'C' || (o_custkey % 9) AS country, (o_custkey % 3)::INT AS kind FROM orders WHERE o_orderkey % 10 <> 0"


def article_lines(spark, d) -> DataFrame:
    """Orders as articles with two themes of three and two places; every tenth has no link."""
    o = t.table(spark, d, "orders")
    country, kind = F.concat(F.lit("C"), F.col("o_custkey") % 9), (F.col("o_custkey") % 3).cast("string")
    place = F.concat_ws("#", kind, F.lit("Name"), country, F.concat(country, F.lit("1")), F.lit("10"), F.lit("20.5"), F.lit("id"))
    own = {0: F.concat(F.lit("g"), "o_orderkey"), 1: compact("o_orderdate"), 3: F.lit("site.example.org"), 4: F.when(F.col("o_orderkey") % 10 == 0, "").otherwise(F.concat(F.lit("http://a/"), "o_orderkey")), 7: F.concat("o_orderpriority", F.lit(";;ALL;"), "o_orderpriority"), 9: F.concat(place, F.lit(";"), place, F.lit(";1#X#US#US#1#2#y;4#short#FR")), 15: F.lit("-1.5,2,3")}
    return o.select(F.concat_ws("\t", *(own.get(i, F.lit('"')) for i in range(17))).alias("value"))


@query("s04_article_files", f"""WITH a AS ({ARTICLE_CELLS}), t AS (SELECT 'g' || o_orderkey AS gkg_id, 'theme' AS what, unnest([o_orderpriority, 'ALL']) AS value, o_orderdate FROM a),
p AS (SELECT 'g' || o_orderkey AS gkg_id, 'place', unnest([country || ' ' || CASE WHEN kind <> 1 THEN country || '1' ELSE '-' END, 'US -']) AS value, o_orderdate FROM a)
SELECT gkg_id, what, value, strftime(o_orderdate, '%Y-%m-%d') AS day, -1.5::DOUBLE AS tone FROM t UNION ALL SELECT *, -1.5 FROM (SELECT gkg_id, 'place', value, strftime(o_orderdate, '%Y-%m-%d') FROM p)""")
def s04(spark, d):
    """Articles, their themes (S05) and their places (S06)."""
    a = files.articles(files.read_lines(spark, land(article_lines(spark, d), "articles")))
    row = lambda rows, what, value: rows.select("gkg_id", F.lit(what).alias("what"), value.alias("value"), F.col("added_at").cast("date").cast("string").alias("day"), "tone")
    place = F.concat_ws(" ", F.col("p.country"), F.coalesce("p.adm1", F.lit("-")))
    return row(a.withColumn("v", F.explode("themes")), "theme", F.col("v")).unionByName(row(a.withColumn("p", F.explode("places")), "place", place))


@query("s29_series_slots", "SELECT strftime(s, '%Y%m%d%H%M%S') || '.export' AS file FROM generate_series((SELECT time_bucket(INTERVAL 15 MINUTE, min(ts)) FROM events), (SELECT max(ts) FROM events), INTERVAL 15 MINUTE) g(s)")
def s29(spark, d):
    ends = t.table(spark, d, "events").agg(stamp(F.min("ts")).alias("a"), stamp(F.max("ts")).alias("b")).first()
    return files.series_slots(spark, ends["a"], ends["b"], ".export").select("file")


@query("s25_gazetteer", "SELECT c_custkey AS id, unnest(list_distinct([c_name, upper(c_mktsegment), 'alt ' || c_custkey])) AS name, n_name AS iso2, c_acctbal::BIGINT AS population FROM customer JOIN nation ON c_nationkey = n_nationkey")
def s25(spark, d):
    c = t.table(spark, d, "customer").join(t.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    population = F.bround("c_acctbal").cast("long").cast("string")
    lines = c.select(F.concat_ws("\t", F.col("c_custkey").cast("string"), "c_name", F.concat(F.upper("c_mktsegment"), F.lit(",,alt "), "c_custkey"), "n_name", F.lit("01"), F.lit("1.5"), F.lit("-2.5"), population).alias("value"))
    places = files.gazetteer(spark, land(lines, "gazetteer"), "city")
    from heliograph.operators.gazetteer import place_names

    named = place_names(places)
    return named.join(places.select(F.col("id").alias("place_id"), "iso2", "population"), "place_id").select(F.col("place_id").alias("id"), "name", "iso2", "population")


@query("s26_country_codes", "SELECT n_nationkey::VARCHAR AS iso2, 'I' || n_nationkey AS iso3, 'F' || n_regionkey AS fips, n_name AS name FROM nation")
def s26(spark, d):
    n = t.table(spark, d, "nation").select(F.concat_ws("\t", F.col("n_nationkey").cast("string"), F.concat(F.lit("I"), "n_nationkey"), F.concat(F.lit("F"), "n_regionkey"), "n_name").alias("value"))
    notes = t.table(spark, d, "region").select(F.concat(F.lit("# "), "r_name").alias("value"))
    return files.country_codes(spark, land(notes.unionByName(n), "codes"))




@query("s27_country_shapes", "SELECT 'F' || n_regionkey AS fips, count(*) AS parts, min(n_nationkey)::DOUBLE AS least_x, min(n_name) AS name FROM nation GROUP BY 1")
def s27(spark, d):
    """Nations as squares; those of a region are parts of one shape."""
    k = F.col("n_nationkey").cast("string")
    ring = F.concat(F.lit("[[["), k, F.lit(",0],["), k, F.lit(".5,0],["), k, F.lit(".5,1],["), k, F.lit(",0]]]"))
    shape = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit('{"type":"Polygon","coordinates":'), ring, F.lit("}"))).otherwise(F.concat(F.lit('{"type":"MultiPolygon","coordinates":['), ring, F.lit("]}")))
    item = F.concat(F.lit('{"properties":{"fips":"F'), F.col("n_regionkey").cast("string"), F.lit('","name":"'), "n_name", F.lit('"},"geometry":'), shape, F.lit("}"))
    docs = documents_of(t.table(spark, d, "nation"), item, '{"features":[', "]}", F.pmod("n_nationkey", F.lit(3)))
    s = files.country_shapes(spark, land(docs, "shapes", "part"))
    return s.select("fips", F.size("geom").cast("long").alias("parts"), F.array_min(F.transform("geom", lambda p: p[0][0]["x"])).alias("least_x"), "name")


@query("s28_manual_ids", "SELECT 'x' AS country, n_name AS name, 'host' AS kind, 'n' || n_nationkey || '.example.org' AS value, 'manual' AS origin FROM nation")
def s28(spark, d):
    n = t.table(spark, d, "nation")
    lines = n.select(F.concat_ws(",", F.lit("x"), "n_name", F.lit("host"), F.concat(F.lit("n"), "n_nationkey", F.lit(".example.org"))).alias("value"))
    head = spark.createDataFrame([("# by hand",), ("country,name,kind,value",)], "value string")
    ids = files.manual_ids(spark, land(head.coalesce(1).unionByName(lines).coalesce(1), "manual"))
    return registry.assert_known(ids, n.select(F.lit("x").alias("country"), F.col("n_name").alias("name")))


def features(rows: DataFrame, item: Column, name: str, key: str = "event_id", head: str = '{"features":[', foot: str = "]}") -> str:
    """rows in feature collections of at most some hundred rows each, however many there are."""
    return land(documents_of(rows, item, head, foot, F.floor(F.col(key) / IN_ONE)), name, "part")




@query("s07_quakes", "SELECT 'q' || user_id AS external_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS added_at, 5.5::DOUBLE AS mag, (user_id % 90)::DOUBLE AS lat FROM events WHERE event_id % 3 <> 0 GROUP BY user_id")
def s07(spark, d):
    """Quakes that are reported again and again: the newest report counts; every third has no magnitude."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    props = F.struct(F.when(F.col("event_id") % 3 != 0, 5.5).alias("mag"), F.lit("there").alias("place"), ms.alias("time"), ms.alias("updated"), F.lit("u").alias("url"), F.lit(1).alias("tsunami"), F.lit("t").alias("title"))
    item = F.to_json(F.struct(F.concat(F.lit("q"), "user_id").alias("id"), props.alias("properties"), F.struct(F.array(F.lit(1.5), (F.col("user_id") % 90).cast("double"), F.lit(9.0)).alias("coordinates")).alias("geometry")))
    e = snapshots.quakes(spark, features(t.table(spark, d, "events"), item, "quakes"))
    return e.select("external_id", stamp("added_at").alias("added_at"), F.get_json_object("props", "$.mag").cast("double").alias("mag"), "lat")


@query("s08_disasters", "SELECT 'EQ' || o_orderkey AS external_id, strftime(o_orderdate, '%Y-%m-%d') AS day, ['Green', 'Orange', 'Red'][(o_orderkey % 3 + 1)::INT] AS alert, (o_custkey % 80)::DOUBLE AS lat, (o_orderkey % 100)::DOUBLE AS severity FROM orders WHERE o_orderkey % 4 <> 0")
def s08(spark, d):
    """Disaster alerts; every fourth has no point."""
    when = F.concat(F.date_format("o_orderdate", "EEE, dd MMM yyyy"), F.lit(" 10:00:00 GMT"))
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    alert = F.element_at(F.array(F.lit("Green"), F.lit("Orange"), F.lit("Red")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    point = F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.concat((F.col("o_custkey") % 80).cast("string"), F.lit(" 20.5")))
    severity = F.concat(F.lit('<gdacs:severity unit="M" value="'), (F.col("o_orderkey") % 100).cast("string"), F.lit('">Magnitude</gdacs:severity>'))
    item = F.concat(F.lit("<item>"), tag("title", F.lit("T")), tag("link", F.lit("l")), tag("pubDate", when), tag("gdacs:eventtype", F.lit("EQ")), tag("gdacs:eventid", F.col("o_orderkey").cast("string")), tag("gdacs:alertlevel", alert), tag("gdacs:iscurrent", F.lit("true")), severity, tag("georss:point", point), F.lit("</item>"))
    docs = t.table(spark, d, "orders").groupBy(F.floor(F.col("o_orderkey") / IN_ONE).cast("string").alias("part")).agg(F.concat(F.lit('<rss xmlns:gdacs="g" xmlns:georss="r"><channel>'), F.array_join(F.collect_list(item), "\n"), F.lit("</channel></rss>")).alias("value"))
    e = snapshots.disasters(spark, land(docs, "disasters", "part"))
    return e.select("external_id", F.to_date("added_at").cast("string").alias("day"), F.get_json_object("props", "$.alert").alias("alert"), "lat", F.get_json_object("props", "$.severity_value").cast("double").alias("severity"))


@query("s12_fire_pixels", "SELECT strftime(ts, '%Y-%m-%d %H:%M:00') AS acq_at, user_id::DOUBLE AS lat, event_id::DOUBLE AS lon, value AS frp FROM events WHERE event_id % 9 <> 0")
def s12(spark, d):
    """Detections; every ninth has no latitude. Times have no leading zeros."""
    e = t.table(spark, d, "events")
    minutes = (F.hour("ts") * 100 + F.minute("ts")).cast("string")
    lat = F.when(F.col("event_id") % 9 == 0, "bad").otherwise(F.col("user_id").cast("string"))
    path = new_folder(spark, "fires")
    e.select(lat.alias("latitude"), F.col("event_id").cast("string").alias("longitude"), F.lit("300").alias("bright_ti4"), F.lit("1").alias("scan"), F.lit("1").alias("track"), F.date_format("ts", "yyyy-MM-dd").alias("acq_date"), minutes.alias("acq_time"), F.lit("N").alias("satellite"), F.lit("high").alias("confidence"), F.lit("2").alias("version"), F.lit("290").alias("bright_ti5"), F.col("value").cast("string").alias("frp"), F.lit("D").alias("daynight")).write.option("header", True).csv(path)
    return snapshots.fire_pixels(spark, path, "N").select(stamp("acq_at").alias("acq_at"), "lat", "lon", "frp")


@query("s13_outages", "SELECT 'country/' || (user_id % 25) || ':' || (epoch_us(ts) // 1000000) || ':b' AS external_id, strftime(max(ts + INTERVAL 1 HOUR), '%Y-%m-%d %H:%M:%S') AS ends, n_name AS country FROM events JOIN nation ON user_id % 25 = n_nationkey WHERE event_id % 2 = 0 AND n_regionkey <> 1 GROUP BY 1, n_name")
def s13(spark, d):
    """Outages of countries, placed by their code (J12); those of networks and of unknown codes are dropped."""
    start = F.unix_timestamp(F.col("ts").cast("timestamp"))
    place = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("country/"), F.col("user_id") % 25)).otherwise(F.lit("asn/1"))
    item = F.to_json(F.struct(place.alias("location"), start.alias("start"), F.lit(3600).alias("duration"), F.lit("b").alias("datasource"), F.col("value").alias("score"), F.lit("N").alias("location_name")))
    n = t.table(spark, d, "nation").filter("n_regionkey <> 1")
    codes = n.select(F.col("n_nationkey").cast("string").alias("iso2"), F.col("n_name").alias("fips"))
    points = n.select(F.col("n_name").alias("fips"), F.lit(1.0).alias("lon"), F.lit(2.0).alias("lat"))
    e = snapshots.placed_codes(snapshots.outages(spark, features(t.table(spark, d, "events"), item, "outages", head='{"data":[')), codes, points)
    return e.select("external_id", stamp(F.get_json_object("props", "$.end").cast("timestamp")).alias("ends"), "country").distinct()


@query("s14_outage_notes", "SELECT 'a' || o_orderkey || ':' || c AS external_id, 'name ' || c AS geo_name, strftime(o_orderdate, '%Y-%m-%d') AS day FROM (SELECT *, unnest(['X' || (o_custkey % 5), 'Y']) AS c FROM orders)")
def s14(spark, d):
    codes = F.array(F.concat(F.lit("X"), F.col("o_custkey") % 5), F.lit("Y"))
    item = F.to_json(F.struct(F.concat(F.lit("a"), "o_orderkey").alias("id"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T10:00:00Z")).alias("startDate"), codes.alias("locations"), F.transform(codes, lambda c: F.struct(c.alias("code"), F.concat(F.lit("name "), c).alias("name"))).alias("locationsDetails")))
    e = snapshots.outage_notes(spark, features(t.table(spark, d, "orders"), item, "notes", "o_orderkey", '{"result":{"annotations":[', "]}}"))
    return e.select("external_id", "geo_name", F.to_date("added_at").cast("string").alias("day"))


@query("s15_conflicts", "SELECT l_orderkey::VARCHAR AS external_id, arg_max((l_quantity)::INT, (l_linenumber, l_quantity)) AS best FROM lineitem WHERE l_linenumber <= 3 GROUP BY l_orderkey")
def s15(spark, d):
    """Conflict events of three monthly releases (S16): an event's newest counts."""
    li = t.table(spark, d, "lineitem").filter("l_linenumber <= 3").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    path = new_folder(spark, "conflicts")
    for n in (1, 2, 3):  # releases come as files of their own names
        rows = li.filter(F.col("l_linenumber") == n).select(F.col("l_orderkey").cast("string").alias("id"), F.lit('Town, "x"\nline').alias("where_coordinates"), F.lit("2026-08-01").alias("date_start"), F.lit("1").alias("latitude"), F.lit("2").alias("longitude"), F.col("q").cast("int").cast("string").alias("best"), *(F.lit("1").alias(c) for c in ("high", "low")), *(F.lit("s").alias(c) for c in ("side_a", "side_b", "conflict_name")))
        rows.write.option("header", True).option("escape", '"').csv(f"{path}/GEDEvent_v26_0_{n}.csv")
    e = snapshots.conflicts(spark, f"{path}/*")
    return e.select("external_id", F.get_json_object("props", "$.best").cast("int").alias("best"))


@query("s17_forecasts", "SELECT 'I' || (o_custkey % 30) AS iso3, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, o_totalprice AS fatalities, 'fatalities003_2024_02_t01' AS run FROM orders")
def s17(spark, d):
    """Pages of the newest of some runs (S18)."""
    o = t.table(spark, d, "orders")
    item = F.to_json(F.struct(F.concat(F.lit("I"), F.col("o_custkey") % 30).alias("isoab"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), F.col("o_totalprice").alias("main_mean"), F.lit(0.5).alias("main_dich")))
    runs = spark.createDataFrame([("fatalities003_2024_02_t01",), ("fatalities002_2024_02_t03",), ("fatalities003_2023_12_t01",), ("x",)], "run string")
    run = snapshots.newest_run(runs).first()["run"]
    f = snapshots.forecasts(spark, features(o, item, "forecasts", "o_orderkey", '{"data":['), run)
    return f.select("iso3", F.col("month").cast("string").alias("month"), "fatalities", "run")


#: Files a micro-batch where all that has landed is one.
EVERY = 1 << 30
EDITS = "SELECT event_id, user_id, event_type AS title, ts, json_extract_string(props, '$.k')::INT % 10 = 0 AS bot FROM events WHERE event_type <> 'view'"


def edit_messages(spark, d, only: Column | None = None) -> DataFrame:
    """Events as edits of a page of their type, those of type view in another namespace, each message twice; of the events that fit
    `only`, if given."""
    e = t.table(spark, d, "events")
    e = e if only is None else e.filter(only)
    bot = F.get_json_object("props", "$.k").cast("int") % 10 == 0
    m = F.to_json(F.struct(F.lit("enwiki").alias("wiki"), F.lit("en.wikipedia.org").alias("server_name"), F.col("event_type").alias("title"), F.when(F.col("event_type") == "view", 1).otherwise(0).alias("namespace"), F.lit("edit").alias("type"), F.col("user_id").cast("string").alias("user"), bot.alias("bot"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("timestamp"), F.struct(F.col("event_id").alias("new")).alias("revision")))
    return e.select(m.alias("value")).withColumn("value", F.explode(F.array("value", "value")))


@query("t01_edit_stream", f"SELECT event_id AS rev, title, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, bot, substr(sha256(user_id::VARCHAR), 1, 12) AS user_hash FROM ({EDITS})")
def t01(spark, d):
    """Edits of a stream (S19), each revision once."""
    out = new_folder(spark, "edits")
    messages = streaming.lines(spark, land(edit_messages(spark, d), "messages"), EVERY)
    streaming.run_once(streaming.edits(messages), out, new_folder(spark, "edits-checkpoint"))
    return spark.read.parquet(out).select("rev", "title", stamp("at").alias("at"), "bot", "user_hash")


def post_messages(spark, d) -> DataFrame:
    """Documents as posts, a minute after each other; every tenth is deleted at the end."""
    return numbered_posts(spark, d).select("value")


def numbered_posts(spark, d) -> DataFrame:
    """(value, doc_id, op) of the messages of all posts, made in one pass over the documents."""
    docs = t.table(spark, d, "documents").filter("text is not null")
    at_us = F.lit(1_790_000_000_000_000) + F.col("doc_id") * 60_000_000
    text = F.when(F.col("op") == "create", F.col("text"))
    message = F.to_json(F.struct(F.lit("d").alias("did"), at_us.alias("time_us"), F.lit("commit").alias("kind"), F.struct(F.lit("app.bsky.feed.post").alias("collection"), F.col("op").alias("operation"), F.col("doc_id").cast("string").alias("rkey"), F.struct(text.alias("text")).alias("record")).alias("commit")))
    ops = F.when(F.col("doc_id") % 10 == 0, F.array(F.lit("create"), F.lit("delete"))).otherwise(F.array(F.lit("create")))
    return docs.select("doc_id", "text", F.explode(ops).alias("op")).select(message.alias("value"), "doc_id", "op")


FIRST_NAMES = "n AS (SELECT DISTINCT regexp_extract(text, '^([A-Z][a-z]+)(?:[^\\p{L}\\p{N}]|$)', 1) AS name FROM documents WHERE text IS NOT NULL), hit AS (SELECT DISTINCT doc_id, w AS name FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) AS w FROM documents WHERE text IS NOT NULL) JOIN n ON n.name = w WHERE w <> '')"


def first_names(spark, d) -> DataFrame:
    head = F.regexp_extract("text", "^([A-Z][a-z]+)(?:[^\\p{L}\\p{N}]|$)", 1)
    return t.table(spark, d, "documents").select(head.alias("name")).filter("name <> ''").distinct().withColumn("place_id", F.xxhash64("name"))


def run_posts(spark, d) -> str:
    folder = new_folder(spark, "posts")
    messages = streaming.lines(spark, land(post_messages(spark, d), "messages"), EVERY)
    streaming.run_once(messages, "", new_folder(spark, "posts-checkpoint"), streaming.post_batches(first_names(spark, d), folder))
    return folder


@query("t02_place_counts", f"WITH {FIRST_NAMES} SELECT name, strftime(time_bucket(INTERVAL 5 MINUTE, make_timestamp(1790000000000000 + doc_id * 60000000)), '%Y-%m-%d %H:%M:%S') AS bucket, count(*) AS posts FROM hit GROUP BY ALL")
def t02(spark, d):
    """Posts of a stream (S20) that name a place, counted in five minutes."""
    counts = streaming.added_counts(spark, run_posts(spark, d))
    return counts.join(first_names(spark, d), "place_id").select("name", stamp("bucket").alias("bucket"), "posts")


@query("t03_first_pointers", f"""WITH {FIRST_NAMES}, f AS (SELECT name, doc_id, row_number() OVER (PARTITION BY name, date_trunc('hour', make_timestamp(1790000000000000 + doc_id * 60000000)) ORDER BY doc_id) AS n FROM hit)
SELECT name, 'at://d/app.bsky.feed.post/' || doc_id AS uri FROM f WHERE n <= 20""")
def t03(spark, d):
    """The first posts of each place and hour, kept by a stateful stream over the landed hits."""
    out = new_folder(spark, "first")
    hits = spark.readStream.schema("at timestamp, uri string, place_id long").parquet(f"{run_posts(spark, d)}/pointers")
    streaming.run_once(streaming.first_pointers(hits), out, new_folder(spark, "first-checkpoint"))
    return spark.read.parquet(out).join(first_names(spark, d), "place_id").select("name", "uri")


@query("t05_hourly_editors", f"SELECT title, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, count(DISTINCT user_id) AS editors FROM ({EDITS}) WHERE NOT bot GROUP BY ALL")
def t05(spark, d):
    """Exact distinct editors of a stream; messages far later close the hours. These come in one run, a micro-batch each, since a run
    starts by reading the state."""
    path, out, cp = land(edit_messages(spark, d), "messages"), new_folder(spark, "editors"), new_folder(spark, "editors-checkpoint")
    run = lambda files: streaming.run_once(streaming.hourly_editors(snapshots.edit_rows(streaming.lines(spark, path, files))), out, cp)
    run(EVERY)
    days = (F.col("id") + 1) * 100
    late = F.to_json(F.struct(F.lit("enwiki").alias("wiki"), F.lit("en.wikipedia.org").alias("server_name"), F.lit("late").alias("title"), F.lit(0).alias("namespace"), F.lit("edit").alias("type"), F.lit("u").alias("user"), F.lit(False).alias("bot"), (1_706_572_800 + 86_400 * days).alias("timestamp"), F.struct((-days).alias("new")).alias("revision")))
    spark.range(0, 3, 1, 3).select(late.alias("value")).write.mode("append").text(path)
    run(1)
    return spark.read.parquet(out).filter("title <> 'late'").select("title", stamp("hour").alias("hour"), "editors")


@query("t09_theme_stream", f"WITH a AS ({ARTICLE_CELLS}) SELECT region, theme, strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS articles FROM (SELECT o_orderkey, o_orderdate, unnest([country, 'US']) AS region, o_orderpriority FROM a) x, unnest([o_orderpriority, 'ALL']) AS u(theme) GROUP BY ALL")
def t09(spark, d):
    """Theme counts of articles as a stream in update mode; readers take the latest value of each key."""
    folder = new_folder(spark, "themes")
    lines = streaming.lines(spark, land(article_lines(spark, d), "articles"), EVERY)
    counts = streaming.theme_counts(files.articles(lines))
    streaming.run_once(counts, "", new_folder(spark, "themes-checkpoint"), streaming.replacing(folder, ["day", "region", "theme"]), "update")
    return streaming.current(spark, folder, ["day", "region", "theme"]).select("region", "theme", F.date_format("day", "yyyy-MM-dd").alias("day"), "articles")


@query("s21_channel_posts", """SELECT event_type AS handle, event_id AS post_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS posted_at, 'Post & ' || event_id AS text, event_id % 900 * 100 + 1000 AS views FROM events""")
def s21(spark, d):
    """Channel pages with some posts each."""
    e = t.table(spark, d, "events")
    post = F.concat(F.lit('<div data-post="'), "event_type", F.lit("/"), F.col("event_id").cast("string"), F.lit('"><time datetime="'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('+00:00"></time><div class="message_text">Post &amp; <a href="https://a.b/c?x=1&amp;y=2">'), F.col("event_id").cast("string"), F.lit('</a></div><span class="message_views">'), F.format_string("%.1fK", (F.col("event_id") % 900) / 10 + 1), F.lit("</span></div>"))
    pages = e.groupBy(F.col("event_type").alias("handle"), F.floor(F.col("event_id") / IN_ONE)).agg(F.concat(F.lit("<html>"), F.array_join(F.collect_list(post), "\n"), F.lit("</html>")).alias("html"))
    return snapshots.channel_posts(pages).select("handle", "post_id", stamp("posted_at").alias("posted_at"), "text", "views")


@query("s22_videos", "SELECT 'v' || c_custkey AS video_id, c_name AS title, greatest(c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 500 END)::BIGINT AS views, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS description FROM customer WHERE c_custkey % 3 <> 0")
def s22(spark, d):
    c = t.table(spark, d, "customer")
    listed = c.select(F.concat(F.lit("v"), "c_custkey").alias("video_id"), F.col("c_name").alias("title"), F.lit(None).cast("timestamp").alias("published"), F.col("c_custkey").alias("views"), F.lit(9).cast("long").alias("length_s"), (F.col("c_custkey") % 3 == 0).alias("upcoming"))
    details = c.filter("c_custkey % 2 = 0").select(F.concat(F.lit("v"), "c_custkey").alias("video_id"), F.col("c_mktsegment").alias("description"), F.array("c_name").alias("keywords"), F.lit(500).cast("long").alias("views"), F.lit(None).cast("timestamp").alias("published"))
    return snapshots.videos(listed, details).select("video_id", "title", "views", "description")


@query("s23_outlet_pages", "SELECT r_name AS country, n_name AS name, 'SC,' || CASE WHEN n_nationkey % 2 = 0 THEN 'IP' ELSE '-' END AS trajectory FROM nation JOIN region ON n_regionkey = r_regionkey")
def s23(spark, d):
    n = t.table(spark, d, "nation").join(t.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    one = F.struct(F.col("n_name").alias("outlet"), F.lit("a").alias("assets"), F.array(F.lit("SC"), F.when(F.col("n_nationkey") % 2 == 0, "IP")).alias("t"))
    page = n.groupBy("r_name").agg(F.collect_list(one).alias("outlets")).select(F.concat(F.lit('<p>x</p><script>const DATA = [{"sr":"s","countries":['), F.to_json(F.struct(F.col("r_name").alias("country"), "outlets")), F.lit("]}];\n</script>")).alias("html"))
    return snapshots.outlet_pages(page).select("country", "name", F.array_join("trajectory", ",").alias("trajectory"))


@query("s09_weather_alerts", "SELECT 'w' || o_orderkey AS external_id, strftime(o_orderdate + INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') AS added_at, ['Severe', 'Minor'][(o_orderkey % 2 + 1)::INT] AS severity, 'w' || (o_orderkey - 1) AS refers, CASE WHEN o_orderkey % 3 = 0 THEN 4 ELSE 0 END AS corners FROM orders")
def s09(spark, d):
    """Alerts that start at their onset, else when they take effect; each refers to the one before; every third has a shape."""
    o = t.table(spark, d, "orders")
    iso = lambda hours: F.date_format(F.col("o_orderdate") + F.expr(f"interval {hours} hours"), "yyyy-MM-dd'T'HH:mm:ssXXX")
    number = F.col("o_orderkey").cast("string")
    severity = F.element_at(F.array(F.lit("Severe"), F.lit("Minor")), (F.col("o_orderkey") % 2 + 1).cast("int"))
    ring = F.array(*(F.array(F.lit(float(a)), F.lit(float(b))) for a, b in ((0, 0), (1, 0), (1, 1), (0, 0))))
    props = F.struct(F.concat(F.lit("w"), number).alias("id"), F.lit("Area").alias("areaDesc"), iso(1).alias("sent"), F.when(F.col("o_orderkey") % 2 == 0, iso(5)).otherwise(iso(3)).alias("effective"), F.when(F.col("o_orderkey") % 2 == 1, iso(5)).alias("onset"), severity.alias("severity"), F.array(F.lit("z")).alias("affectedZones"), F.array(F.struct(F.concat(F.lit("w"), (F.col("o_orderkey") - 1).cast("string")).alias("identifier"))).alias("references"))
    geometry = F.when(F.col("o_orderkey") % 3 == 0, F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))
    a = snapshots.weather_alerts(spark, features(o, F.to_json(F.struct(geometry.alias("geometry"), props.alias("properties"))), "weather", "o_orderkey"))
    return a.select("external_id", stamp("added_at").alias("added_at"), F.get_json_object("props", "$.severity").alias("severity"), F.col("refs")[0].alias("refers"), F.coalesce(F.size(F.col("geom")[0][0]), F.lit(0)).alias("corners"))


@query("s10_tsunami_bulletins", "SELECT 't' || o_orderkey AS external_id, strftime(o_orderdate, '%Y-%m-%d') AS day, ['Warning', 'Information'][(o_orderkey % 2 + 1)::INT] AS category, CASE WHEN o_orderkey % 4 > 0 THEN (o_custkey % 9) / 10 + 6 END AS magnitude FROM orders WHERE o_orderkey % 5 <> 0")
def s10(spark, d):
    """Bulletins with category and magnitude in the summary's markup; every fifth has no place, every fourth no magnitude."""
    o = t.table(spark, d, "orders")
    number = F.col("o_orderkey").cast("string")
    kind = F.element_at(F.array(F.lit("Warning"), F.lit("Information")), (F.col("o_orderkey") % 2 + 1).cast("int"))
    place = F.when(F.col("o_orderkey") % 5 == 0, "").otherwise("<geo:lat>1.5</geo:lat><geo:long>2.5</geo:long>")
    size = F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.concat(F.lit("<b>Preliminary Magnitude:</b> "), ((F.col("o_custkey") % 9) / 10 + 6).cast("decimal(3,1)").cast("string"), F.lit("(Mw)")))
    entry = F.concat(F.lit("<entry><id>t"), number, F.lit("</id><title>T</title><updated>"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T10:00:00Z</updated>"), place, F.lit("<summary><div><b>Category:</b> "), kind, F.lit("<br/>"), size, F.lit("</div></summary></entry>"))
    docs = o.groupBy(F.floor(F.col("o_orderkey") / IN_ONE).cast("string").alias("part")).agg(F.concat(F.lit('<feed xmlns:geo="g">'), F.array_join(F.collect_list(entry), "\n"), F.lit("</feed>")).alias("value"))
    e = snapshots.tsunami_bulletins(spark, land(docs, "tsunami", "part"))
    return e.select("external_id", F.to_date("added_at").cast("string").alias("day"), F.get_json_object("props", "$.category").alias("category"), F.get_json_object("props", "$.magnitude").cast("double").alias("magnitude"))


@query("s11_volcanoes", "SELECT n_nationkey || ':20260907' || lpad((n_nationkey % 24)::VARCHAR, 2, '0') || '0041' AS external_id, n_name AS geo_name, 'ORANGE' AS color FROM nation WHERE n_regionkey <> 3")
def s11(spark, d):
    """Elevated volcanoes; those of a region have no time of change."""
    n = t.table(spark, d, "nation")
    changed = F.when(F.col("n_regionkey") != 3, F.format_string("2026-09-07 %02d:00:41", F.col("n_nationkey").cast("int") % 24))
    item = F.to_json(F.struct(F.col("n_nationkey").cast("string").alias("vnum"), F.col("n_name").alias("vName"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("long"), F.lit("ORANGE").alias("colorCode"), changed.alias("codeChangeDate")))
    e = snapshots.volcanoes(spark, features(n, item, "volcanoes", "n_nationkey", "[", "]"), F.lit("2026-09-20 12:00:00").cast("timestamp"))
    return e.select("external_id", "geo_name", F.get_json_object("props", "$.color").alias("color"))


@query("f12_usable_names", """WITH n AS (SELECT DISTINCT unnest([w, upper(w), lower(w), w || '1', left(w, 2), left(upper(w), 3)]) AS name FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-zÀ-ÖÙ-Üà-öù-ü]+')) AS w FROM documents)), m AS (SELECT name, length(name) % 2 = 0 AS main FROM n)
SELECT name FROM m WHERE NOT regexp_matches(name, '\\p{Nd}') AND CASE WHEN regexp_matches(name, '^\\p{Lu}') THEN length(name) >= 3 AND NOT (upper(name) = name AND length(name) <= 4 AND NOT main) WHEN regexp_matches(name, '^\\p{Ll}') OR NOT regexp_matches(name, '^\\p{L}') THEN false ELSE length(name) >= 3 END""")
def f12(spark, d):
    from heliograph.functions import usable_name

    w = t.table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-zÀ-ÖÙ-Üà-öù-ü]+"), F.lit(0))).alias("w"))
    forms = F.array(F.col("w"), F.upper("w"), F.lower("w"), F.concat("w", F.lit("1")), F.substring("w", 1, 2), F.substring(F.upper("w"), 1, 3))
    names = w.select(F.explode(forms).alias("name")).distinct()
    return names.filter(usable_name(F.col("name"), F.length("name") % 2 == 0))


# The archive.


def archived_event(spark, d) -> DataFrame:
    o = t.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("added_at"), F.pmod("o_orderkey", F.lit(5)).cast("int").alias("source_id"), F.col("o_totalprice").cast("float").alias("price"), F.array("o_orderpriority").alias("tags"))


def archive_names(spark) -> DataFrame:
    return spark.createDataFrame([(0, "gdacs-alerts"), (1, "other")], "id int, name string")


CUT = "TIMESTAMP '1995-04-15' - INTERVAL 60 DAY"


@query("m07_archive_round_trip", f"SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS tag, o_totalprice::FLOAT::DOUBLE AS price, o_orderdate < {CUT} AND o_orderkey % 5 <> 0 AS cold FROM orders")
def m07(spark, d):
    """Orders as events: those that are due are in the archive, single precision widened, and no longer hot, the others stay; read by
    SQL over a view (S31, S32)."""
    folder = new_folder(spark, "archive")
    tables = {"event": archived_event(spark, d), "source": archive_names(spark)}
    hot, _, failed = archive.archive_all(tables, folder, F.lit("1995-04-15 13:00:00").cast("timestamp"))
    if failed:
        raise RuntimeError(str(failed))
    cold = archive.archive_query(spark, "SELECT id, added_at, tags, price, true AS cold FROM event", folder, ["event", "none"])
    both = cold.unionByName(hot["event"].select("id", "added_at", "tags", F.col("price").cast("double").alias("price"), F.lit(False).alias("cold")))
    return both.select("id", F.date_format("added_at", "yyyy-MM-dd").alias("day"), F.col("tags")[0].alias("tag"), "price", "cold")


@query("u14_failures_apart", f"""SELECT 'event' AS table_name, count(*) FILTER (o_orderdate < {CUT} AND o_orderkey % 5 <> 0) AS archived, false AS failed FROM orders UNION ALL SELECT 'wiki_activity', 0, true
UNION ALL SELECT 'gkg_location', count(*), false FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate < TIMESTAMP '1995-04-15' - INTERVAL 30 DAY UNION ALL SELECT 'gkg_article', count(*), false FROM orders WHERE o_orderdate < TIMESTAMP '1995-04-15' - INTERVAL 30 DAY""")
def u14(spark, d):
    """A table that fails stops no other; child rows leave with their parents."""
    event = archived_event(spark, d)
    child = t.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("article_id"), "l_linenumber", "l_quantity")
    tables = {"event": event, "source": archive_names(spark), "wiki_activity": event.drop("added_at"), "gkg_article": event.withColumnRenamed("id", "article_id").drop("source_id"), "gkg_location": child}
    _, done, failed = archive.archive_all(tables, new_folder(spark, "archive"), F.lit("1995-04-15 13:00:00").cast("timestamp"))
    return spark.createDataFrame([(k, done.get(k, 0), k in failed) for k in {*done, *failed}], "table_name string, archived long, failed boolean")


@query("u16_pruned_buffers", "SELECT 'mention' AS table_name, count(*) FILTER (ts >= TIMESTAMP '2024-01-20' - INTERVAL 72 HOUR) AS left_rows FROM events UNION ALL SELECT 'chatter_5min', count(*) FILTER (ts >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAY) FROM events UNION ALL SELECT 'event', count(*) FROM orders UNION ALL SELECT 'kept mention', count(*) FROM events")
def u16(spark, d):
    """Without a folder buffers lose their old rows and archived tables none; without pruning nothing changes."""
    from heliograph.operators import jobs

    e = t.table(spark, d, "events")
    tables = {"mention": e.withColumnRenamed("ts", "mentioned_at"), "chatter_5min": e.withColumnRenamed("ts", "bucket"), "event": archived_event(spark, d)}
    out, _, _ = jobs.pruned(tables, None, at("2024-01-20 00:00:00"))
    kept, _, _ = jobs.pruned(tables, None, at("2024-01-20 00:00:00"), prune=False)
    counts = [v.agg(F.count("*").alias("left_rows")).select(F.lit(k).alias("table_name"), "left_rows") for k, v in {**out, "kept mention": kept["mention"]}.items()]
    both = counts[0]
    for c in counts[1:]:
        both = both.unionByName(c)
    return both


# Places.

WIDE = "shape AS (SELECT 'S' || x || '_' || y AS code, x * 40.0 - 160 AS x1, y * 30.0 - 75 AS y1 FROM range(8) a(x), range(5) b(y) WHERE (x + y) % 2 = 0)"


@query("j10_reverse_geocode", f"""WITH {WIDE}, point AS (SELECT vec_id AS id, embedding[1]::DOUBLE * 400 AS lon, embedding[2]::DOUBLE * 160 AS lat FROM embeddings),
c AS (SELECT id, code, greatest(x1 - lon, lon - (x1 + 20), 0) AS dx, greatest(y1 - lat, lat - (y1 + 15), 0) AS dy, lat FROM point, shape),
n AS (SELECT id, code, sqrt(dx * dx + dy * dy) AS deg, 111.195 * sqrt(dx * cos(radians(lat)) * dx * cos(radians(lat)) + dy * dy) AS km FROM c)
SELECT p.id, coalesce((SELECT code FROM n WHERE n.id = p.id AND km <= 300 ORDER BY deg, code LIMIT 1), '') AS country FROM point p""")
def j10(spark, d):
    """Points in rectangles or, within 300 km, of the nearest one (J09, J10, M03)."""
    box = lambda x, y: [[{"x": float(a), "y": float(b)} for a, b in ((x, y), (x + 20, y), (x + 20, y + 15), (x, y + 15))]]
    shapes = spark.createDataFrame([(f"S{i}_{j}", [box(i * 40 - 160, j * 30 - 75)]) for i in range(8) for j in range(5) if (i + j) % 2 == 0], f"code string, geom {geo.SHAPE}")
    p = t.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("embedding")[0].cast("double") * 400).alias("lon"), (F.col("embedding")[1].cast("double") * 160).alias("lat"))
    return geo.reverse_geocode(p, shapes, 300.0).select("id", "country")


@query("k05_nearest_places", """WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE * 400 AS lon, embedding[2]::DOUBLE * 200 AS lat FROM embeddings), q AS (SELECT n_nationkey AS place_id, n_nationkey * 14.0 - 175 AS p_lon, (n_nationkey * 37 % 160) - 80.0 AS p_lat FROM nation),
c AS (SELECT id, place_id, 2 * 6371.0088 * asin(least(1, sqrt(pow(sin(radians(p_lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(p_lat)) * pow(sin(radians(p_lon - lon) / 2), 2)))) AS km FROM p, q)
SELECT id, place_id, round(km, 6) AS km, row_number() OVER (PARTITION BY id ORDER BY km, place_id)::INT AS n FROM c QUALIFY n <= 2""")
def k05(spark, d):
    p = t.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("embedding")[0].cast("double") * 400).alias("lon"), (F.col("embedding")[1].cast("double") * 200).alias("lat"))
    q = t.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_nationkey") * 14.0 - 175).cast("double").alias("lon"), (F.pmod(F.col("n_nationkey") * 37, F.lit(160)) - 80.0).cast("double").alias("lat"))
    return geo.nearest(p, q, 2).select("id", "place_id", F.round("km", 6).alias("km"), "n")


@query("j11_fire_joins", """WITH p AS (SELECT event_id AS id, (user_id % 25)::DOUBLE + (event_id % 50) * 0.001 AS lon, 65.0 + (event_id % 30) * 0.0005 AS lat, ts FROM events),
f AS (SELECT 2 * n_nationkey + k AS fire_id, CASE k WHEN 0 THEN n_nationkey + 0.025 ELSE n_nationkey END AS x1, CASE k WHEN 0 THEN n_nationkey + 0.026 ELSE n_nationkey + 0.04 END AS x2,
  CASE k WHEN 0 THEN 65.0 ELSE 65.0165 END AS y1, CASE k WHEN 0 THEN 65.0005 ELSE 65.017 END AS y2, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * n_nationkey AS last_seen FROM nation, (VALUES (0), (1)) v(k)),
c AS (SELECT id, fire_id, greatest(x1 - lon, lon - x2, 0) AS dx, greatest(y1 - lat, lat - y2, 0) AS dy, lat FROM p JOIN f ON abs(lon - x1) < 1 AND last_seen > ts - INTERVAL 48 HOUR)
SELECT id, fire_id FROM c WHERE sqrt(dx * dx + dy * dy) <= 0.018 AND 111.195 * sqrt(dx * cos(radians(lat)) * dx * cos(radians(lat)) + dy * dy) <= 1.0
QUALIFY row_number() OVER (PARTITION BY id ORDER BY sqrt(dx * dx + dy * dy), fire_id) = 1""")
def j11(spark, d):
    """Detections at 65 degrees north, where a degree of longitude is short: of a fire to the east and one to the north the nearer in
    degrees is not always the nearer in kilometres."""
    e = t.table(spark, d, "events")
    pixels = e.select(F.col("event_id").alias("id"), ((F.col("user_id") % 25) + (F.col("event_id") % 50) * 0.001).cast("double").alias("lon"), (65.0 + (F.col("event_id") % 30) * 0.0005).cast("double").alias("lat"), F.col("ts").alias("acq_at"))
    n, x = t.table(spark, d, "nation"), F.col("n_nationkey").cast("double")
    box = lambda x1, x2, y1, y2: F.array(*(F.struct(a.alias("x"), F.lit(b).alias("y")) for a, b in ((x1, y1), (x2, y1), (x2, y2), (x1, y2))))
    hulls = F.array(F.struct(F.lit(0).alias("k"), box(x + 0.025, x + 0.026, 65.0, 65.0005).alias("hull")), F.struct(F.lit(1).alias("k"), box(x, x + 0.04, 65.0165, 65.017).alias("hull")))
    fires = n.withColumn("h", F.explode(hulls)).select((F.col("n_nationkey") * 2 + F.col("h.k")).alias("fire_id"), F.col("h.hull").alias("hull"), (at("2024-01-01 00:00:00") + F.make_dt_interval(days=F.col("n_nationkey").cast("int"))).alias("last_seen"))
    return geo.join_fires(pixels, fires)


@query("g04_fires", """WITH RECURSIVE p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS lon, embedding[2]::DOUBLE AS lat FROM embeddings), e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON sqrt((a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat)) <= 0.009),
r(id, root) AS (SELECT id, id FROM p UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id), c AS (SELECT id, min(root) AS fire_id FROM r GROUP BY id), pt AS (SELECT DISTINCT fire_id, lon AS x, lat AS y FROM c JOIN p USING (id)), way AS (SELECT a.fire_id, a.x, a.y, atan2(b.y - a.y, b.x - a.x) AS t FROM pt a JOIN pt b ON a.fire_id = b.fire_id AND (a.x <> b.x OR a.y <> b.y)),
turn AS (SELECT fire_id, x, y, coalesce(lead(t) OVER w, min(t) OVER (PARTITION BY fire_id, x, y) + 2 * pi()) - t AS free FROM way WINDOW w AS (PARTITION BY fire_id, x, y ORDER BY t)),
corner AS (SELECT fire_id, x, y, avg(x) OVER (PARTITION BY fire_id) AS cx, avg(y) OVER (PARTITION BY fire_id) AS cy FROM (SELECT fire_id, x, y FROM turn GROUP BY fire_id, x, y HAVING max(free) > pi())),
ring AS (SELECT *, row_number() OVER (PARTITION BY fire_id ORDER BY atan2(y - cy, x - cx)) AS k, count(*) OVER (PARTITION BY fire_id) AS n FROM corner),
hull AS (SELECT a.fire_id, count(*)::INT AS corners, abs(sum((radians(b.x) - radians(a.x)) * (2 + sin(radians(a.y)) + sin(radians(b.y))))) / 2 * 6371.0088 * 6371.0088 AS area FROM ring a JOIN ring b ON a.fire_id = b.fire_id AND b.k = a.k % a.n + 1 GROUP BY a.fire_id)
SELECT fire_id, count(*) AS detections, count(*) FILTER (id % 2 = 0) AS high_conf, round(sum(id), 3) AS frp_sum, max(id)::DOUBLE AS frp_max, coalesce(any_value(corners), 1) AS corners, round(coalesce(any_value(CASE WHEN corners > 2 THEN area END), 0), 6) AS area_km2 FROM c LEFT JOIN hull USING (fire_id) GROUP BY fire_id""")
def g04(spark, d):
    """All detections of one run in which no fire is known: clusters, their heads (A23), totals and hulls (A13)."""
    p = t.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("lon"), F.col("embedding")[1].cast("double").alias("lat"), at().alias("acq_at"), F.col("vec_id").cast("double").alias("frp"), F.when(F.col("vec_id") % 2 == 0, "high").otherwise("low").alias("confidence"))
    none = spark.createDataFrame([], f"fire_id long, hull {geo.HULL}, last_seen timestamp_ntz")
    _, totals = geo.track_fires(p.withColumn("fire_id", F.lit(None).cast("long")).limit(0), p, none)
    return totals.select("fire_id", "detections", "high_conf", F.round("frp_sum", 3).alias("frp_sum"), "frp_max", F.size("hull").alias("corners"), F.round("area_km2", 6).alias("area_km2"))


@query("j13_placed_alerts", "SELECT o_orderkey AS external_id, CASE WHEN o_orderkey % 3 = 0 THEN 'own' ELSE 'zones' END AS within FROM orders WHERE o_orderkey % 3 <> 2")
def j13(spark, d):
    """Alerts on their own shape or in the union of their zones; each must lie where it belongs, and those without either are dropped."""
    o = t.table(spark, d, "orders")
    box = lambda x, w: F.array(F.array(F.array(*(F.struct((x + a).cast("double").alias("x"), F.lit(float(b)).alias("y")) for a, b in ((0, 0), (w, 0), (w, w), (0, w))))))
    own, zone = F.col("o_orderkey") % 100, F.col("o_custkey") % 25
    a = o.select(F.col("o_orderkey").alias("external_id"), F.when(F.col("o_orderkey") % 3 == 0, box(own, 1)).alias("geom"), F.when(F.col("o_orderkey") % 3 == 1, F.array(F.concat(F.lit("z"), zone), F.lit("big"), F.lit("none"))).otherwise(F.array().cast("array<string>")).alias("zones"))
    z = t.table(spark, d, "nation").select(F.concat(F.lit("z"), "n_nationkey").alias("url"), box(F.col("n_nationkey") * 2, 1).alias("geom")).unionByName(spark.range(1).select(F.lit("big").alias("url"), box(F.lit(-100), 9).alias("geom")))
    p = geo.place_alerts(a, z)
    where = F.when(F.col("geom").isNotNull() & (F.floor("lon") == F.col("external_id") % 100), "own").when(F.col("geom").isNull() & F.col("lon").between(-100, -91), "zones")
    return p.select("external_id", where.alias("within"))


@query("a23_cluster_heads", "SELECT user_id AS cluster, arg_min(event_id, (ts, event_id)) AS fire_id FROM events GROUP BY user_id")
def a23(spark, d):
    e = t.table(spark, d, "events")
    return geo.cluster_heads(e.select(F.col("event_id").alias("id"), F.col("user_id").alias("cluster")), e.select(F.col("event_id").alias("id"), F.col("ts").alias("acq_at")))
