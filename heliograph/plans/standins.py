"""The driver's tables in the roles of the engine's own: what they stand in for, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"
#: A moment in the middle of the data, for queries over the last hours.
MIDDAY = "2024-01-20 12:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def at(moment: str = AS_OF) -> Column:
    return F.lit(moment).cast("timestamp_ntz")


def stamp(c: str | Column) -> Column:
    """A time as text, the same in every engine and time zone."""
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd HH:mm:ss")


def mention(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("event_id"), F.col("ts").alias("mentioned_at"), F.get_json_object("props", "$.k").alias("source_name"))


def event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer with events is an event of the news, first seen with the first of these; six share a link."""
    first = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("added_at"))
    places = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    part = lambda n: F.pmod(F.col("c_custkey"), F.lit(n))
    return places.join(first, F.col("c_custkey") == F.col("user_id")).select(
        F.col("c_custkey").alias("id"), F.col("n_name").alias("country"), F.concat("n_name", "c_mktsegment").alias("adm1"), "added_at",
        F.concat(F.lit("https://site.example.org/"), F.floor(F.col("c_custkey") / 6).cast("string")).alias("url"),
        F.concat("n_name", F.lit(" "), part(3).cast("string")).alias("geo_name"), part(2).cast("int").alias("geo_type"), part(7).cast("int").alias("num_sources"), part(11).cast("int").alias("num_mentions"),
        part(4).cast("int").alias("source_id"),
    )


def story(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines of the links of `event`, one for each page, from the pages' titles; every fifth failed."""
    return table(spark, sf_dir, "pages").select(
        F.concat(F.lit("https://site.example.org/"), F.col("page_id").cast("string")).alias("url"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract("url", "^[A-Za-z]+://([^/:?#]+)", 1).alias("site"),
        F.when(F.col("page_id") % 5 == 4, "fail").otherwise("ok").alias("status"), F.pmod(F.col("page_id"), F.lit(4)).cast("int").alias("attempts"),
        F.lit("2024-01-20 01:00:00").cast("timestamp_ntz").alias("fetched_at"),
    )


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, "files", "s0", True, True, 900), (1, "files", "s1", True, True, 86400), (2, "feed", "s2", True, False, 1036800), (3, "feed", "s3", False, True, 60), (9, "feed", "s9", True, False, 900)], "id int, kind string, name string, enabled boolean, attention boolean, expect_every long")


CTES = {
    "mention": "mention AS (SELECT user_id AS event_id, ts AS mentioned_at, json_extract_string(props, '$.k') AS source_name FROM events)",
    "event": """event AS (SELECT c_custkey AS id, n_name AS country, n_name || c_mktsegment AS adm1, f.added_at, 'https://site.example.org/' || (c_custkey // 6) AS url,
        n_name || ' ' || (c_custkey % 3) AS geo_name, (c_custkey % 2)::INT AS geo_type, (c_custkey % 7)::INT AS num_sources, (c_custkey % 11)::INT AS num_mentions, (c_custkey % 4)::INT AS source_id
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN (SELECT user_id, min(ts) AS added_at FROM events GROUP BY 1) f ON f.user_id = c_custkey)""",
    "story": """story AS (SELECT 'https://site.example.org/' || page_id AS url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1) AS site,
        CASE WHEN page_id % 5 = 4 THEN 'fail' ELSE 'ok' END AS status, (page_id % 4)::INT AS attempts, TIMESTAMP '2024-01-20 01:00:00' AS fetched_at FROM pages)""",
    "sources": "sources(id, kind, name, enabled, attention, expect_every) AS (VALUES (0, 'files', 's0', true, true, 900), (1, 'files', 's1', true, true, 86400), (2, 'feed', 's2', true, false, 1036800), (3, 'feed', 's3', false, true, 60), (9, 'feed', 's9', true, false, 900))",
    "region_event": "region_event AS (SELECT 'country' AS region_kind, country AS region, e.* FROM event e WHERE country <> '' UNION ALL SELECT 'adm1', adm1, e.* FROM event e WHERE adm1 <> '')",
    "coverage": """coverage AS (SELECT r.region_kind, r.region, date_trunc('hour', m.mentioned_at) AS hour, count(*) AS mentions, count(DISTINCT source_name) AS sources
        FROM mention m JOIN region_event r ON m.event_id = r.id GROUP BY ALL)""",
    "sightings": "sightings AS (SELECT region_kind, region, date_trunc('hour', added_at) AS hour, count(*) AS events FROM region_event GROUP BY ALL)",
    "hourly": """hourly AS (SELECT region_kind, region, hour, coalesce(events, 0) AS events, coalesce(mentions, 0) AS mentions, coalesce(sources, 0) AS sources
        FROM sightings FULL JOIN coverage USING (region_kind, region, hour))""",
    "daily": "daily AS (SELECT region_kind, region, hour::DATE AS day, sum(events)::BIGINT AS events, sum(mentions)::BIGINT AS mentions, sum(sources)::BIGINT AS sources FROM hourly GROUP BY ALL)",
    "anomaly": """anomaly AS (SELECT h.region_kind, h.region, h.hour, h.mentions, sum(coalesce(p.mentions, 0)) / 30.0::DOUBLE AS mean,
        sqrt((30 * sum(coalesce(p.mentions, 0) * coalesce(p.mentions, 0)) - sum(coalesce(p.mentions, 0)) * sum(coalesce(p.mentions, 0)))::DOUBLE) / 30 AS sd
        FROM hourly h LEFT JOIN hourly p ON p.region_kind = h.region_kind AND p.region = h.region AND p.hour < h.hour AND p.hour >= h.hour - INTERVAL 30 DAY AND hour(p.hour) = hour(h.hour)
        GROUP BY ALL)""",
}
#: What each needs before it.
BEFORE = {"region_event": ["event"], "coverage": ["mention", "region_event"], "sightings": ["region_event"], "hourly": ["sightings", "coverage"], "daily": ["hourly"], "anomaly": ["hourly"]}


def with_(names: str, query: str) -> str:
    """query behind the common table expressions it names, each after what it needs."""
    done: list[str] = []

    def add(name: str) -> None:
        for x in BEFORE.get(name, []):
            add(x)
        if name not in done:
            done.append(name)

    for name in names.split():
        add(name)
    return "WITH " + ",\n".join(CTES[n] for n in done) + ("" if query.lstrip().startswith(",") else "\n") + query
