"""Queries over whole runs: series published by day, feeds through the runner, file series with a ledger, streams that fail, reload,
retract and freeze."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph import functions as own
from heliograph import streaming
from heliograph.operators import gazetteer, geo, jobs, publish, source_jobs
from heliograph.shared import checkpointed, new_folder
from heliograph.sources import files, snapshots
from heliograph.streaming import batches

from . import standins as t
from .landed import EDITS, EVERY, FIRST_NAMES, compact, edit_messages, event_lines, features, first_names, land, numbered_posts
from .standins import at, stamp, with_

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


class Stopped(Exception):
    """A run that was made to fail."""


# The hourly series, published by day.


@query("u04_published_days", with_("sightings coverage", """, f AS (SELECT min(mentioned_at) AS t FROM mention), b AS (SELECT CASE WHEN date_trunc('hour', t) = t THEN t ELSE date_trunc('hour', t) + INTERVAL 1 HOUR END AS first FROM f),
held AS (SELECT coverage.* FROM coverage, b WHERE coverage.hour >= first)
SELECT region_kind, region, strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, coalesce(events, 0) AS events, coalesce(mentions, 0) AS mentions, coalesce(sources, 0) AS sources FROM sightings FULL JOIN held USING (region_kind, region, hour)"""))
def u04(spark, d):
    """A full run, a later one that fails while it writes, readers who must not see it, and the later one twice. The hour in which the
    buffer of mentions begins is not whole, so it has none."""
    e, m = t.event(spark, d), t.mention(spark, d)
    folder, first = new_folder(spark, "hours"), at("2024-01-20 00:00:00")
    jobs.published_hours(spark, folder, e.filter(F.col("added_at") < first), m.filter(F.col("mentioned_at") < first), first, 24 * 60)
    read = lambda: publish.current(spark, folder, jobs.HOURLY.replace("timestamp", "timestamp_ntz")).drop("day")
    before = read().agg(F.count("*"), F.sum("mentions"), F.max("hour")).first()
    broken = F.when(F.col("user_id") % 1000 == 1, F.raise_error(F.lit("stop"))).otherwise(F.get_json_object("props", "$.k"))
    try:
        bad = t.table(spark, d, "events").select(F.col("user_id").alias("event_id"), F.col("ts").alias("mentioned_at"), broken.cast("string").alias("source_name"))
        jobs.published_hours(spark, folder, e, bad, at(), 24 * 13)
    except Exception as x:
        if "stop" not in str(x):
            raise
    else:
        raise AssertionError("the run was to fail")
    if read().agg(F.count("*"), F.sum("mentions"), F.max("hour")).first() != before:
        raise AssertionError("readers saw a run that failed")
    for _ in range(2):
        jobs.published_hours(spark, folder, e, m, at(), 24 * 13)
    return read().withColumn("hour", stamp("hour"))


# Feeds through the runner.

SHAPES = [("S0", 1.0, 0.0, 2.0, 30.0), ("S1", 1.0, 30.0, 2.0, 45.0)]
FEEDS = """q AS (SELECT user_id, arg_max(ts, (event_id % 2, ts)) AS newest, (user_id % 900) / 10.0::DOUBLE AS lat FROM events GROUP BY user_id),
w AS (SELECT o_orderkey AS k, o_orderdate AS day FROM orders)"""


def shapes(spark) -> DataFrame:
    ring = lambda x1, y1, x2, y2: [[[{"x": x, "y": y} for x, y in ((x1, y1), (x2, y1), (x2, y2), (x1, y2))]]]
    return spark.createDataFrame([(code, ring(*box)) for code, *box in SHAPES], f"code string, geom {geo.SHAPE}")


def quake_feed(rows: DataFrame) -> str:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    props = F.struct(F.lit(5.5).alias("mag"), F.lit("there").alias("place"), ms.alias("time"), ms.alias("updated"))
    item = F.to_json(F.struct(F.concat(F.lit("q"), "user_id").alias("id"), props.alias("properties"), F.struct(F.array(F.lit(1.5), (F.col("user_id") % 900) / 10.0, F.lit(9.0)).alias("coordinates")).alias("geometry")))
    return features(rows, item, "quakes")


def weather_feed(rows: DataFrame) -> str:
    """Alerts that refer to the one before; every third has its own shape, the others a zone."""
    number, ring = F.col("o_orderkey").cast("string"), [(1.2, 5.0), (1.4, 5.0), (1.4, 6.0), (1.2, 6.0)]
    own_shape = F.struct(F.lit("Polygon").alias("type"), F.array(F.array(*(F.array(F.lit(a), F.lit(b)) for a, b in ring))).alias("coordinates"))
    props = F.struct(F.concat(F.lit("w"), number).alias("id"), F.lit("Area").alias("areaDesc"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("sent"), F.array(F.lit("z")).alias("affectedZones"), F.array(F.struct(F.concat(F.lit("w"), (F.col("o_orderkey") - 1).cast("string")).alias("identifier"))).alias("references"))
    return features(rows, F.to_json(F.struct(F.when(F.col("o_orderkey") % 3 == 0, own_shape).alias("geometry"), props.alias("properties"))), "weather", "o_orderkey")


@query("m03_feed_runs", f"""WITH {FEEDS}
SELECT 'quakes' AS feed, 'q' || user_id AS key, strftime(newest, '%Y-%m-%d %H:%M:%S') AS at, CASE WHEN lat < 30 THEN 'S0' WHEN lat < 45 OR (lat - 45) * 111.195 <= 100 THEN 'S1' ELSE '' END AS country, NULL AS superseded_by, 0::BIGINT AS seen FROM q
UNION ALL SELECT 'weather', 'w' || a.k, strftime(a.day, '%Y-%m-%d %H:%M:%S'), CASE WHEN a.k % 3 = 0 THEN 'S0' ELSE 'S1' END, CASE WHEN b.k IS NOT NULL THEN 'w' || b.k END, 0 FROM w a LEFT JOIN w b ON b.k = a.k + 1
UNION ALL SELECT 'ledger', 'quakes:202401310000', NULL, NULL, NULL, (SELECT count(DISTINCT user_id) FROM events WHERE event_id % 2 = 1)
UNION ALL SELECT 'ledger', 'weather:202401310000', NULL, NULL, NULL, (SELECT count(*) FROM w)""")
def m03(spark, d):
    """Two kinds of feed through one runner: quakes that come again and are placed by their point, and alerts placed by shape or
    zone that later ones refer to; only blank countries are looked up, and the ledger has what the writes have counted."""
    e, o, land_of = t.table(spark, d, "events"), t.table(spark, d, "orders"), shapes(spark)
    base = spark.createDataFrame([], snapshots.schemas.EVENT)
    quakes = source_jobs.SourceJob("quakes", snapshots.quakes)
    first, _ = source_jobs.run_source(spark, quakes, quake_feed(e.filter("event_id % 2 = 0")), base, land_of, at("2024-01-30 00:00:00"))
    second, q_log = source_jobs.run_source(spark, quakes, quake_feed(e.filter("event_id % 2 = 1")), first, land_of, at())
    zone = spark.createDataFrame([("z", [[[{"x": x, "y": y} for x, y in ((1.2, 40.0), (1.4, 40.0), (1.4, 41.0), (1.2, 41.0))]]])], f"url string, geom {geo.SHAPE}")
    weather = source_jobs.SourceJob("weather", snapshots.weather_alerts, place=lambda rows: geo.place_alerts(rows, zone), refers=True)
    alerts, w_log = source_jobs.run_source(spark, weather, weather_feed(o), base.withColumn("superseded_by", F.lit(None).cast("string")), land_of, at())
    row = lambda rows, feed, by: rows.select(F.lit(feed).alias("feed"), F.col("external_id").alias("key"), stamp("added_at").alias("at"), "country", by.alias("superseded_by"), F.lit(0).cast("long").alias("seen"))
    none = F.lit(None).cast("string")
    logged = q_log.unionByName(w_log).select(F.lit("ledger").alias("feed"), F.col("file").alias("key"), none.alias("at"), none.alias("country"), none.alias("superseded_by"), F.col("rows_kept").alias("seen"))
    return row(second, "quakes", none).unionByName(row(alerts, "weather", F.col("superseded_by"))).unionByName(logged)


@query("a22_counted_write", "SELECT count(*) AS rows_seen, count(*) FILTER (event_id % 5 <> 0 AND event_id % 7 <> 0) AS rows_kept FROM events")
def a22(spark, d):
    """Rows seen and kept as the write itself counts them, for the ledger."""
    rows = files.event_rows(files.read_lines(spark, land(event_lines(spark, d), "events")))
    counts = source_jobs.counted_write(rows, F.col("kept"), new_folder(spark, "kept"))
    return spark.range(1).select(*(F.lit(counts[c]).cast("long").alias(c) for c in ("rows_seen", "rows_kept")))


# File series.


def land_as(rows: DataFrame, folder: str, suffix: str) -> None:
    """The lines of rows as files of a landing folder whose names end as a series asks."""
    spark, path = rows.sparkSession, land(rows, "series")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    to = jvm.org.apache.hadoop.fs.Path(folder)
    fs = to.getFileSystem(conf)
    fs.mkdirs(to)
    for k, x in enumerate(x for x in fs.listStatus(jvm.org.apache.hadoop.fs.Path(path)) if x.getPath().getName().startswith("part-")):
        fs.rename(x.getPath(), jvm.org.apache.hadoop.fs.Path(f"{folder}/{k:05d}{suffix}"))


def mention_lines(spark, d) -> DataFrame:
    """A mention of the next event by each; every sixth line is too short."""
    full = F.array((F.col("event_id") + 1).cast("string"), F.lit(""), compact("ts"), F.lit("1"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")), *(F.lit("x") for _ in range(11)))
    return t.table(spark, d, "events").select(F.concat_ws("\t", F.when(F.col("event_id") % 6 == 0, F.slice(full, 1, 10)).otherwise(full)).alias("value"))


SERIES = """WITH ev AS (SELECT event_id, event_id % 5 <> 0 AND event_id % 7 <> 0 AS kept FROM events),
me AS (SELECT m.event_id, strftime(m.ts, '%Y-%m-%d %H:%M:%S') AS said_at, m.event_id % 6 <> 0 AND e.kept IS NOT NULL AS kept FROM events m LEFT JOIN ev e ON e.event_id = m.event_id + 1 AND e.kept),
ar AS (SELECT o_orderkey, o_orderkey % 10 <> 0 AS kept FROM orders)
SELECT 'event' AS what, event_id::VARCHAR AS key, 1::BIGINT AS n FROM ev WHERE kept UNION ALL SELECT 'mention', (event_id + 1) || ' ' || said_at, count(*) FROM me WHERE kept GROUP BY ALL UNION ALL SELECT 'article', 'g' || o_orderkey, 1 FROM ar WHERE kept
UNION ALL SELECT 'ledger', kind || ' seen', n FROM (SELECT 'events' AS kind, count(*) AS n FROM ev UNION ALL SELECT 'mentions', count(*) FROM me UNION ALL SELECT 'articles', count(*) FROM ar)
UNION ALL SELECT 'ledger', kind || ' kept', n FROM (SELECT 'events' AS kind, count(*) FILTER (kept) AS n FROM ev UNION ALL SELECT 'mentions', count(*) FILTER (kept) FROM me UNION ALL SELECT 'articles', count(*) FILTER (kept) FROM ar)"""


@query("t08_file_series", SERIES)
def t08_series(spark, d):
    """Event, mention and article files of one landing folder in one stream with a ledger. The first run stops between events and
    mentions of a batch; the second starts at that batch again."""
    from .landed import article_lines

    landing, folder, cp = (new_folder(spark, x) for x in ("landing", "loaded", "series-checkpoint"))
    land_as(event_lines(spark, d), landing, ".export")
    land_as(mention_lines(spark, d), landing, ".mentions")
    land_as(article_lines(spark, d), landing, ".gkg")

    def stop(batch_id: int, what: str) -> None:
        if what == "mentions":
            raise Stopped(f"batch {batch_id} before {what}")

    fails(lambda: batches.load_files(spark, landing, folder, cp, EVERY, stop))
    if batches.loaded(spark, folder, "events") is not None:
        raise AssertionError("readers saw half a batch")
    batches.load_files(spark, landing, folder, cp, EVERY)
    get = lambda kind: batches.loaded(spark, folder, kind)
    row = lambda rows, what, key, n: rows.select(F.lit(what).alias("what"), key.alias("key"), n.cast("long").alias("n"))
    said = get("mentions").groupBy(F.concat_ws(" ", "event_id", stamp("mentioned_at")).alias("key")).agg(F.count("*").alias("n"))
    ledger = get("ledger").groupBy("kind").agg(F.sum("rows_seen").alias("seen"), F.sum("rows_kept").alias("kept"))
    return (
        row(get("events"), "event", F.col("external_id"), F.lit(1))
        .unionByName(row(said, "mention", F.col("key"), F.col("n")))
        .unionByName(row(get("articles"), "article", F.col("gkg_id"), F.lit(1)))
        .unionByName(row(ledger, "ledger", F.concat("kind", F.lit(" seen")), F.col("seen")))
        .unionByName(row(ledger, "ledger", F.concat("kind", F.lit(" kept")), F.col("kept")))
    )


def fails(run) -> None:
    """Runs what is made to fail, and sees to it that it fails of that alone."""
    try:
        run()
    except Exception as x:
        if "Stopped" not in str(x):
            raise
    else:
        raise AssertionError("the run was to fail")


# Posts.

POSTED = "make_timestamp(1790000000000000 + doc_id * 60000000)"
LIVE = f"""f AS (SELECT name, doc_id, row_number() OVER (PARTITION BY name, date_trunc('hour', {POSTED}) ORDER BY doc_id) AS n FROM hit),
live AS (SELECT name, 'at://d/app.bsky.feed.post/' || doc_id AS uri FROM f WHERE n <= 20 AND doc_id % 10 <> 0 AND {POSTED} > (SELECT max({POSTED}) FROM documents WHERE text IS NOT NULL) - INTERVAL 48 HOUR)"""


def halves(spark, d) -> tuple[DataFrame, DataFrame]:
    """Posts of the first half of documents, and those of the others with all deletions."""
    middle = t.table(spark, d, "documents").agg(F.floor(F.max("doc_id") / 2).alias("m")).first()["m"]
    every = numbered_posts(spark, d)
    early = (F.col("doc_id") <= middle) & (F.col("op") == "create")
    return every.filter(early).select("value"), every.filter(~early).select("value")


def two_landings(spark, d, names, fail=None, between=None) -> str:
    """Posts that land in two lots, through one stream; `fail` stops the second batch once, `between` is done before it."""
    landing, folder, cp = (new_folder(spark, x) for x in ("messages", "posts", "posts-checkpoint"))
    run = lambda fail=None: streaming.run_once(streaming.lines(spark, landing, EVERY), "", cp, batches.live_posts(names, folder, fail=fail))
    for k, rows in enumerate(halves(spark, d)):
        rows.write.mode("append").text(landing)
        if k and between:
            between()
        if k and fail:
            fails(lambda: run(fail))
        run()
    return folder


@query("t04_live_pointers", f"WITH {FIRST_NAMES}, {LIVE} SELECT name, uri FROM live")
def t04(spark, d):
    """The stream's own pointers: the first posts of each place and hour, without those deleted since, for 48 hours."""
    names = checkpointed(first_names(spark, d))
    return batches.live_now(spark, two_landings(spark, d, lambda: names)).join(names, "place_id").select("name", "uri")


@query("t07_failed_batch", f"""WITH {FIRST_NAMES}, {LIVE} SELECT 'pointer' AS what, name, uri AS key, 1::BIGINT AS n FROM live
UNION ALL SELECT 'count', name, strftime(time_bucket(INTERVAL 5 MINUTE, {POSTED}), '%Y-%m-%d %H:%M:%S'), count(*) FROM hit GROUP BY ALL""")
def t07(spark, d):
    """A batch that fails once its counts are written and before its pointers are: run again from the checkpoint, it counts nothing twice."""
    names = checkpointed(first_names(spark, d))

    def stop(batch_id: int, what: str) -> None:
        raise Stopped(f"batch {batch_id} before {what}")

    folder = two_landings(spark, d, lambda: names, stop)
    counts = streaming.added_counts(spark, folder).join(names, "place_id").select(F.lit("count").alias("what"), "name", stamp("bucket").alias("key"), F.col("posts").alias("n"))
    live = batches.live_now(spark, folder).join(names, "place_id").select(F.lit("pointer").alias("what"), "name", F.col("uri").alias("key"), F.lit(1).cast("long").alias("n"))
    return counts.unionByName(live)


@query("t10_names_reloaded", f"""WITH {FIRST_NAMES}, m AS (SELECT max(doc_id) // 2 AS m FROM documents) SELECT name, count(*) AS posts FROM hit, m
WHERE (length(name) % 2 = 0 OR doc_id > m) AND NOT (length(name) = 5 AND doc_id > m) GROUP BY name""")
def t10(spark, d):
    """Names are read anew in each batch: half of them land between two batches, and stop names too."""
    names, stops = new_folder(spark, "names"), new_folder(spark, "stops")
    every = checkpointed(first_names(spark, d))
    every.filter(F.length("name") % 2 == 0).write.parquet(names)

    def land_more() -> None:
        every.filter(F.length("name") % 2 == 1).write.mode("append").parquet(names)
        every.filter(F.length("name") == 5).select("name").write.parquet(stops)

    folder = two_landings(spark, d, batches.names_from(spark, names, stops), between=land_more)
    return streaming.added_counts(spark, folder).join(every, "place_id").groupBy("name").agg(F.sum("posts").alias("posts"))


@query("t06_frozen_hours", f"""WITH e AS ({EDITS}), h AS (SELECT max(ts) - INTERVAL 72 HOUR AS t FROM e WHERE event_id % 10 <> 0), f AS (SELECT CASE WHEN date_trunc('hour', t) = t THEN t ELSE date_trunc('hour', t) + INTERVAL 1 HOUR END AS floor FROM h)
SELECT title, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS edits, count(DISTINCT user_id) FILTER (NOT bot) AS editors FROM e, f WHERE event_id % 10 <> 0 OR ts >= floor GROUP BY ALL""")
def t06(spark, d):
    """A tenth of the edits comes late: those of hours that the buffer holds whole are counted there, older ones change nothing."""
    landing, folder, cp = (new_folder(spark, x) for x in ("messages", "edits", "edits-checkpoint"))
    for late in (False, True):
        edit_messages(spark, d, (F.col("event_id") % 10 == 0) == F.lit(late)).write.mode("append").text(landing)
        streaming.run_once(streaming.lines(spark, landing, EVERY), "", cp, batches.edit_batches(folder))
    return batches.edit_hours(spark, folder).select("title", stamp("hour").alias("hour"), "edits", "editors")


# Sources that no other query reads.


@query("s24_outlet_profiles", "SELECT r_name AS country, n_name AS name, ['SC', 'IP'][(n_nationkey % 2 + 1)::INT] AS typology, '-,' || CASE WHEN n_nationkey % 3 = 0 THEN 'SC' ELSE '-' END || ',-,-,' || ['SC', 'IP'][(n_nationkey % 2 + 1)::INT] AS trajectory FROM nation JOIN region ON n_regionkey = r_regionkey")
def s24(spark, d):
    """Profile cards of outlets; some name the kind of one year, all that of the last."""
    n = t.table(spark, d, "nation").join(t.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    kind = F.element_at(F.array(F.lit("SC"), F.lit("IP")), (F.col("n_nationkey") % 2 + 1).cast("int"))
    fact = lambda name, value: F.concat(F.lit(f"<dt>{name}</dt> <dd>"), value, F.lit("</dd>"))
    years = F.concat(F.when(F.col("n_nationkey") % 3 == 0, "2023: SC ").otherwise(""), F.lit("2026: "), kind)
    pages = n.select(F.concat(F.lit(" "), "n_name", F.lit(" ")).alias("title"), F.concat(F.lit("<dl>"), fact("Country", F.col("r_name")), fact("Typology", kind), F.lit("</dl><p>"), years, F.lit("</p>")).alias("html"))
    return snapshots.outlet_profiles(pages).select("country", "name", "typology", F.array_join("trajectory", ",").alias("trajectory"))


@query("j23_place_divisions", "SELECT c_custkey AS id, 'F' || n_regionkey AS fips, CASE WHEN c_custkey % 3 <> 0 THEN 'F' || n_regionkey || lpad((c_custkey % 7)::VARCHAR, 2, '0') END AS division FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 4 UNION ALL SELECT c_custkey, NULL, NULL FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 4")
def j23(spark, d):
    """Places of a gazetteer file with the code of their country and division; countries of one region are not in the code table, and
    every third place has no division."""
    n, c = t.table(spark, d, "nation"), t.table(spark, d, "customer")
    codes = files.country_codes(spark, land(n.filter("n_regionkey <> 4").select(F.concat_ws("\t", F.concat(F.lit("N"), "n_nationkey"), F.lit("I"), F.concat(F.lit("F"), "n_regionkey"), "n_name").alias("value")), "codes"))
    admin = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.lpad((F.col("c_custkey") % 7).cast("string"), 2, "0"))
    lines = c.select(F.concat_ws("\t", F.col("c_custkey").cast("string"), "c_name", F.lit(""), F.concat(F.lit("N"), "c_nationkey"), admin, F.lit("1.5"), F.lit("2.5"), F.lit("10")).alias("value"))
    return gazetteer.with_country(files.gazetteer(spark, land(lines, "gazetteer"), "city"), codes).select("id", "fips", "division")


def channel_id(key: Column) -> Column:
    return F.concat(F.lit("UC"), F.substring(F.sha2(key.cast("string"), 256), 1, 22))


@query("f11_good_channels", "SELECT c_custkey AS id, c_custkey % 3 = 0 AS good FROM customer")
def f11(spark, d):
    """Of made identifiers, every third is whole; the others are a sign short or have a foreign sign."""
    whole = channel_id(F.col("c_custkey"))
    value = F.when(F.col("c_custkey") % 3 == 0, whole).when(F.col("c_custkey") % 3 == 1, F.substring(whole, 1, 23)).otherwise(F.concat(F.substring(whole, 1, 23), F.lit("!")))
    return t.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), own.good_channel_id(value).alias("good"))


