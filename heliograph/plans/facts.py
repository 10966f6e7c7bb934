"""Queries over write semantics, themes, health, registry and places."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliograph.functions import all_fields_json
from heliograph.operators import facts, geo, registry, rollup, upsert
from heliograph.shared import checkpointed

from . import attention
from . import standins as t
from .standins import AS_OF, at, stamp, with_

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# Write semantics: lineitem's first rows of an order are stored, its third and fourth are a revision of the
# rows of number 1 and 2 that changes some columns.


def lines(spark, d):
    li = t.table(spark, d, "lineitem")
    note = F.when(F.col("l_linestatus") == "O", "").otherwise(F.col("l_linestatus"))
    cols = lambda n: [F.col("l_orderkey").alias("k"), n.cast("int").alias("n"), F.col("l_quantity").alias("qty"), F.col("l_returnflag").alias("flag"), note.alias("note"), F.col("l_extendedprice").alias("price")]
    best = [F.desc("qty"), F.desc("price")]
    old = upsert.one_per_key(li.filter("l_linenumber <= 2").select(*cols(F.col("l_linenumber"))), ["k", "n"], best)
    new = upsert.one_per_key(li.filter("l_linenumber in (3, 4)").select(*cols(F.col("l_linenumber") - 1)), ["k", "n"], best)
    return old, new


NEW_ONE = "new1 AS (SELECT l_orderkey AS k, (l_linenumber - 1)::INT AS n, l_quantity AS qty, l_returnflag AS flag, CASE WHEN l_linestatus = 'O' THEN '' ELSE l_linestatus END AS note, l_extendedprice AS price FROM lineitem WHERE l_linenumber IN (3, 4) QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity DESC, l_extendedprice DESC) = 1)"
OLD_FIRST = "old1 AS (SELECT l_orderkey AS k, l_linenumber::INT AS n, l_quantity AS qty, l_returnflag AS flag, CASE WHEN l_linestatus = 'O' THEN '' ELSE l_linestatus END AS note, l_extendedprice AS price FROM lineitem WHERE l_linenumber <= 2 QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity DESC, l_extendedprice DESC) = 1)"
BOTH = f"WITH {OLD_FIRST}, {NEW_ONE} "


@query("u01_insert_or_skip", BOTH + "SELECT * FROM old1 UNION ALL SELECT * FROM new1 WHERE (k, n) NOT IN (SELECT (k, n) FROM old1)")
def u01(spark, d):
    old, new = lines(spark, d)
    return upsert.insert_or_skip(old, new, ["k", "n"])


@query("u02_policy_upsert", BOTH + """SELECT coalesce(o.k, w.k) AS k, coalesce(o.n, w.n) AS n, CASE WHEN w.k IS NULL THEN o.qty ELSE w.qty END AS qty, CASE WHEN o.k IS NULL THEN w.flag ELSE o.flag END AS flag,
CASE WHEN w.k IS NULL OR (o.k IS NOT NULL AND w.note = '') THEN o.note ELSE w.note END AS note, CASE WHEN o.k IS NULL THEN w.price WHEN w.k IS NULL THEN o.price ELSE greatest(o.price, w.price) END AS price
FROM old1 o FULL JOIN new1 w ON o.k = w.k AND o.n = w.n""")
def u02(spark, d):
    old, new = lines(spark, d)
    return upsert.merge(old, new, ["k", "n"], {"flag": "keep", "note": "nonblank", "price": "last"})


@query("u03_add_counts", "SELECT event_type, user_id, count(*) AS posts FROM events GROUP BY ALL")
def u03(spark, d):
    count = lambda rows: rows.groupBy("event_type", "user_id").agg(F.count("*").alias("posts"))
    e = t.table(spark, d, "events")
    return upsert.add_counts(count(e.filter("event_id % 2 = 0")), count(e.filter("event_id % 2 = 1")), ["event_type", "user_id"], ["posts"])


@query("u04_recompute_window", with_("hourly", "SELECT region_kind, region, strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, CASE WHEN hour >= TIMESTAMP '2024-01-25' THEN events ELSE 0 END AS events, mentions, sources FROM hourly"))
def u04(spark, d):
    """Events of stored rows were lost; those from a moment on are counted anew, other measures stay."""
    base = attention.hourly(spark, d)
    since = F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")
    out = rollup.recomputed(base.withColumn("events", F.lit(0).cast("long")), base.select(*rollup.KEY, "events"), since)
    return out.withColumn("hour", stamp("hour"))


@query("u05_keep_where_null", BOTH + "SELECT coalesce(o.k, w.k) AS k, coalesce(o.n, w.n) AS n, coalesce(nullif(w.note, ''), o.note) AS note FROM old1 o FULL JOIN new1 w ON o.k = w.k AND o.n = w.n")
def u05(spark, d):
    old, new = lines(spark, d)
    return upsert.merge(old.select("k", "n", "note"), new.select("k", "n", F.nullif("note", F.lit("")).alias("note")), ["k", "n"], {"note": "fill"})


@query("u06_observed", "SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen, max_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def u06(spark, d):
    e = t.table(spark, d, "events").withColumn("seen", F.struct("ts", "event_id"))
    o = upsert.observed(e, ["user_id"], "seen", ["event_type"])
    return o.select("user_id", stamp("first_seen.ts").alias("first_seen"), stamp("last_seen.ts").alias("last_seen"), "event_type")


@query("u07_by_origin", "SELECT user_id, event_type FROM events WHERE event_type IN ('view', 'click', 'purchase', 'signup') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END, event_type) = 1")
def u07(spark, d):
    e = t.table(spark, d, "events").filter(F.col("event_type").isin("view", "click", "purchase", "signup")).select("user_id", "event_type").distinct()
    return upsert.by_origin(e, ["user_id"], "event_type", {"purchase": 0, "signup": 1, "view": 2, "click": 2})


@query("u08_count_attempts", with_("story", "SELECT url, CASE WHEN url LIKE '%1' THEN 'ok' ELSE status END AS status, (CASE WHEN url LIKE '%1' THEN attempts + 1 ELSE attempts END)::INT AS attempts FROM story"))
def u08(spark, d):
    s = t.story(spark, d).select("url", "status", "attempts")
    return upsert.count_attempts(s, s.filter(F.col("url").endswith("1")).select("url", F.lit("ok").alias("status")), ["url"])


LOG = """fetch_log AS (SELECT (user_id % 4)::INT AS source_id, event_type || '-' || strftime(ts, '%Y%m%d') AS file, ts AS fetched_at, (event_id % 3)::INT AS rows_kept, event_id FROM events)"""


def fetch_log(spark, d):
    e = t.table(spark, d, "events")
    return e.select(F.pmod("user_id", F.lit(4)).cast("int").alias("source_id"), F.concat("event_type", F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("file"), F.col("ts").alias("fetched_at"), F.pmod("event_id", F.lit(3)).cast("int").alias("rows_kept"), "event_id")


@query("u09_ledger", f"WITH {LOG} SELECT source_id, file, strftime(max(fetched_at), '%Y-%m-%d %H:%M:%S') AS fetched_at FROM fetch_log GROUP BY ALL")
def u09(spark, d):
    return upsert.ledger(fetch_log(spark, d)).select("source_id", "file", stamp("fetched_at").alias("fetched_at"))


@query("u15_retention", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 72 HOUR")
def u15(spark, d):
    from heliograph.operators.archive import retained

    return retained(t.table(spark, d, "events"), "ts", at(), "72 hours").select("event_id")


@query("u17_children_of_new", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0)")
def u17(spark, d):
    o = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return upsert.children_of_new(o.filter("l_orderkey % 5 <> 0"), o, t.table(spark, d, "lineitem"), ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("a22_seen_and_kept", "SELECT event_type, count(*) AS rows_seen, count(*) FILTER (value > 50) AS rows_kept FROM events GROUP BY ALL")
def a22(spark, d):
    return upsert.seen_and_kept(t.table(spark, d, "events"), F.col("value") > 50, "event_type")


@query("a12_source_health", with_("sources", f""", {LOG}
SELECT s.name, s.kind, s.enabled, s.expect_every::BIGINT AS expect_every, strftime(max(f.fetched_at), '%Y-%m-%d %H:%M:%S') AS last_fetch, strftime(max(f.fetched_at) FILTER (f.rows_kept > 0), '%Y-%m-%d %H:%M:%S') AS last_rows,
  count(f.fetched_at) FILTER (f.fetched_at > TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY) AS fetches_24h, coalesce(sum(f.rows_kept) FILTER (f.fetched_at > TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY), 0)::BIGINT AS rows_24h,
  s.enabled AND coalesce(max(f.fetched_at) FILTER (f.rows_kept > 0), TIMESTAMP '0001-01-01') < TIMESTAMP '{AS_OF}' - 3 * s.expect_every * INTERVAL 1 SECOND AS stale
FROM sources s LEFT JOIN fetch_log f ON f.source_id = s.id GROUP BY s.id, s.name, s.kind, s.enabled, s.expect_every"""))
def a12(spark, d):
    h = facts.source_health(t.sources(spark), fetch_log(spark, d), at())
    return h.withColumn("last_fetch", stamp("last_fetch")).withColumn("last_rows", stamp("last_rows"))


@query("a16_freshness", f"WITH {LOG} SELECT strftime(max(fetched_at), '%Y-%m-%d %H:%M:%S') AS newest FROM fetch_log WHERE source_id IN (0, 1)")
def a16(spark, d):
    from heliograph.operators import share

    return share.freshness(fetch_log(spark, d), t.sources(spark), "files").select(stamp("newest").alias("newest"))


@query("m06_series_gaps", """SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS slot FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 15 MINUTE) g(s)
WHERE s NOT IN (SELECT time_bucket(INTERVAL 15 MINUTE, ts) FROM events WHERE event_type = 'purchase')""")
def m06(spark, d):
    from heliograph.functions import quarter_hour

    loaded = t.table(spark, d, "events").filter("event_type = 'purchase'").select(quarter_hour(F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("slot"))
    return facts.gaps(facts.expected_slots(spark, "2024-01-01 00:00:00", "2024-01-30 00:00:00"), loaded).select(stamp("slot").alias("slot"))


@query("s30_unloaded_files", f"WITH {LOG}, files AS (SELECT DISTINCT source_id, file FROM fetch_log) SELECT source_id, file FROM files WHERE (source_id, file) NOT IN (SELECT (source_id, file) FROM fetch_log WHERE event_id % 3 = 0 AND fetched_at < TIMESTAMP '2024-01-15')")
def s30(spark, d):
    log = fetch_log(spark, d)
    return facts.unloaded(log.select("source_id", "file").distinct(), log.filter((F.col("event_id") % 3 == 0) & (F.col("fetched_at") < at("2024-01-15 00:00:00"))))


@query("f24_active_source", "SELECT s_name AS name, 'K' || s_nationkey AS kind FROM supplier WHERE s_acctbal > 4000 AND s_name IN (SELECT s_name FROM supplier WHERE s_suppkey <= 6)")
def f24(spark, d):
    """Of six suppliers as sources, by name, those that are enabled."""
    s = t.table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.concat(F.lit("K"), "s_nationkey").alias("kind"), (F.col("s_acctbal") > 4000).alias("enabled"), "s_suppkey")
    names = [r["name"] for r in s.filter("s_suppkey <= 6").select("name").collect()]
    return facts.active_sources(s, names).select("name", "kind")


ARTICLES = """article AS (SELECT doc_id AS article_id, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (doc_id % 100) AS added_at, list_distinct(regexp_extract_all(text, '[A-Z][a-z]{5,}')) AS themes, source, lang FROM documents),
place AS (SELECT article_id, source AS country, CASE WHEN lang = 'en' THEN NULL ELSE source || lang END AS adm1 FROM article UNION ALL SELECT article_id, source, source || 'x' FROM article WHERE article_id % 2 = 0)"""


def articles(spark, d):
    docs = t.table(spark, d, "documents")
    a = docs.select(F.col("doc_id").alias("article_id"), (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=F.pmod("doc_id", F.lit(100)).cast("int"))).alias("added_at"), F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{5,}"), F.lit(0))).alias("themes"), "source", "lang")
    p = a.select("article_id", F.col("source").alias("country"), F.when(F.col("lang") != "en", F.concat("source", "lang")).alias("adm1"))
    more = a.filter("article_id % 2 = 0").select("article_id", F.col("source").alias("country"), F.concat("source", F.lit("x")).alias("adm1"))
    return a, p.unionByName(more)


@query("a11_theme_daily", f"""WITH {ARTICLES}, r AS (SELECT article_id, 'country' AS region_kind, country AS region FROM place UNION SELECT article_id, 'adm1', adm1 FROM place WHERE adm1 IS NOT NULL)
SELECT region_kind, region, theme, strftime(added_at, '%Y-%m-%d') AS day, count(*) AS articles FROM (SELECT article_id, added_at, unnest(themes) AS theme FROM article) JOIN r USING (article_id) GROUP BY ALL""")
def a11(spark, d):
    return facts.theme_daily(*articles(spark, d)).withColumn("day", F.col("day").cast("string"))


@query("a11_theme_hourly", f"""WITH {ARTICLES}, r AS (SELECT DISTINCT article_id, country AS region FROM place)
SELECT region, theme, strftime(date_trunc('hour', added_at), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS articles FROM (SELECT article_id, added_at, unnest(themes) AS theme FROM article) JOIN r USING (article_id) GROUP BY ALL""")
def a11_hourly(spark, d):
    return facts.theme_hourly(*articles(spark, d)).withColumn("hour", stamp("hour"))


HOSTS = """host AS (SELECT DISTINCT array_to_string(string_split(h, '.')[-2:], '.') AS value FROM (SELECT regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1) AS h FROM pages)),
ids AS (SELECT 'C' || length(value) AS country, 'outlet ' || value AS name, value FROM host)"""


def outlets(spark, d):
    from heliograph.functions import host_suffixes, link_host

    h = t.table(spark, d, "pages").select(link_host(F.col("url")).alias("h")).filter("h is not null").select(F.element_at(host_suffixes(F.col("h")), -2).alias("value")).distinct()
    ids = h.select(F.concat(F.lit("C"), F.length("value").cast("string")).alias("country"), F.concat(F.lit("outlet "), "value").alias("name"), F.lit("host").alias("kind"), "value")
    return ids, ids.select("country", "name", F.lit("state").alias("typology"))


@query("j04_suffix_join", f"WITH {HOSTS} SELECT page_id, name AS outlet FROM pages JOIN ids ON regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1) = value OR regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1) LIKE '%.' || value")
def j04(spark, d):
    from heliograph.functions import link_host

    ids, known = outlets(spark, d)
    return registry.match_hosts(t.table(spark, d, "pages").filter(link_host(F.col("url")).isNotNull()), link_host(F.col("url")), ids, known).select("page_id", "outlet")


LINK_HOST = "lower(regexp_extract(l.url, '^[A-Za-z]+://([^/:?#]+)', 1))"
LINKED = f"JOIN ids ON {LINK_HOST} = ids.value OR {LINK_HOST} LIKE '%.' || ids.value"


@query("j05_post_links", f"""WITH {HOSTS}, c AS (SELECT DISTINCT lang AS handle FROM documents WHERE lang <> 'de'),
l AS (SELECT d.lang AS handle, d.doc_id AS post_id, u.url FROM documents d JOIN c ON c.handle = d.lang JOIN (SELECT page_id, unnest([url, 'https://' || upper(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)) || '/x', 'mailto:a@b']) AS url FROM pages) u ON u.page_id = d.doc_id)
SELECT handle, post_id, l.url, ids.name AS outlet FROM l {LINKED}""")
def j05(spark, d):
    """Documents as posts of the channel of their language, with the links of the page of their number."""
    ids, known = outlets(spark, d)
    host = F.regexp_extract("url", "^[A-Za-z]+://([^/:?#]+)", 1)
    links = t.table(spark, d, "pages").select(F.col("page_id").alias("post_id"), F.array("url", F.concat(F.lit("https://"), F.upper(host), F.lit("/x")), F.lit("mailto:a@b")).alias("links"))
    docs = t.table(spark, d, "documents").select(F.col("lang").alias("handle"), F.col("doc_id").alias("post_id"), at().alias("posted_at"))
    channels = docs.select("handle").distinct().filter("handle <> 'de'")
    return registry.post_links(docs.join(links, "post_id"), channels, ids, known).select("handle", "post_id", "url", "outlet")


@query("j06_description_links", f"""WITH {HOSTS}, l AS (SELECT page_id, unnest(regexp_extract_all(url || ' ' || html, '(https?://[^\\s<>"'')]+)', 1)) AS url FROM pages)
SELECT page_id, l.url, ids.name AS outlet FROM l {LINKED}""")
def j06(spark, d):
    ids, known = outlets(spark, d)
    v = t.table(spark, d, "pages").select(F.col("page_id").alias("video_id"), F.lit("c").alias("channel_id"), F.concat_ws(" ", "url", "html").alias("description"))
    return registry.description_links(v, v.select("channel_id").distinct(), ids, known).select(F.col("video_id").alias("page_id"), "url", "outlet")


@query("a21_silent_hosts", """WITH p AS (SELECT regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1) AS h, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (page_id % 240) AS came FROM pages), ids AS (SELECT DISTINCT h AS value FROM p WHERE h <> ''), seen AS (SELECT DISTINCT h FROM p WHERE came > TIMESTAMP '2024-01-14' - INTERVAL 7 DAY)
SELECT value FROM ids WHERE NOT EXISTS (SELECT 1 FROM seen WHERE h = value OR h LIKE '%.' || value)""")
def a21(spark, d):
    """Pages came in 240 hours; some hosts had theirs early only."""
    from heliograph.functions import link_host

    a = t.table(spark, d, "pages").select(link_host(F.col("url")).alias("site"), (at("2024-01-01 00:00:00") + F.make_dt_interval(hours=(F.col("page_id") % 240).cast("int"))).alias("added_at"))
    ids = a.filter("site is not null").select(F.lit("host").alias("kind"), F.col("site").alias("value")).distinct()
    return registry.silent_hosts(ids, a, at("2024-01-14 00:00:00")).select("value")


@query("a21_outlets_without_host", f"WITH {HOSTS} SELECT DISTINCT n_name AS name FROM nation WHERE n_name NOT IN (SELECT 'NATION_' || length(value) FROM ids)")
def a21_outlets(spark, d):
    """Of an outlet for each nation, those that have no host; an outlet has the hosts of as many letters as its number."""
    ids, _ = outlets(spark, d)
    nations = t.table(spark, d, "nation").select(F.lit("x").alias("country"), F.col("n_name").alias("name"))
    of = ids.select(F.lit("x").alias("country"), F.concat(F.lit("NATION_"), F.length("value").cast("string")).alias("name"), "kind", "value")
    return registry.without_host(nations, of).select("name").distinct()


@query("a21_channel_gaps", """WITH ids AS (SELECT c_name AS name, 'chan_' || c_custkey AS handle, c_custkey % 3 AS p FROM customer), lately AS (SELECT DISTINCT 'chan_' || user_id AS handle FROM events WHERE ts > TIMESTAMP '2024-01-20' - INTERVAL 7 DAY AND ts < TIMESTAMP '2024-01-20')
SELECT name, handle, CASE WHEN p = 0 THEN 'no preview' ELSE 'no post in 7 days' END AS gap FROM ids WHERE p = 0 OR handle NOT IN (SELECT handle FROM lately)""")
def a21_channels(spark, d):
    c = t.table(spark, d, "customer").select(F.lit("x").alias("country"), F.col("c_name").alias("name"), F.concat(F.lit("chan_"), "c_custkey").alias("value"), F.pmod("c_custkey", F.lit(3)).alias("p"))
    ids = c.withColumn("kind", F.lit("telegram")).unionByName(c.withColumn("value", F.concat("value", F.lit("bot"))).withColumn("kind", F.lit("telegram")))
    channels = c.select(F.col("value").alias("handle"), F.when(F.col("p") == 0, False).when(F.col("p") == 1, True).alias("preview")).filter("preview is not null")
    posts = t.table(spark, d, "events").filter(F.col("ts") < at("2024-01-20 00:00:00")).select(F.concat(F.lit("chan_"), "user_id").alias("handle"), F.col("ts").alias("posted_at"))
    return registry.channel_gaps(ids, channels, posts, at("2024-01-20 00:00:00")).select("name", "handle", "gap")


@query("a21_video_gaps", """WITH lately AS (SELECT DISTINCT user_id FROM events WHERE ts > TIMESTAMP '2024-01-20' - INTERVAL 7 DAY AND ts < TIMESTAMP '2024-01-20')
SELECT c_custkey AS channel_id, CASE WHEN c_custkey % 5 = 0 THEN 'gone: ' || left(c_mktsegment, 60) ELSE 'no upload in 7 days' END AS gap FROM customer WHERE c_custkey % 5 = 0 OR c_custkey NOT IN (SELECT user_id FROM lately)""")
def a21_videos(spark, d):
    c = t.table(spark, d, "customer").select(F.lit("x").alias("country"), F.col("c_name").alias("name"), F.col("c_custkey").alias("channel_id"), F.when(F.col("c_custkey") % 5 == 0, "gone").otherwise("live").alias("status"), F.col("c_mktsegment").alias("reason"))
    v = t.table(spark, d, "events").filter(F.col("ts") < at("2024-01-20 00:00:00")).select(F.col("user_id").alias("channel_id"), F.col("ts").alias("published_at"))
    return registry.video_gaps(c, v, at("2024-01-20 00:00:00")).select("channel_id", "gap")


@query("j21_resolved_outlets", """WITH n AS (SELECT n_nationkey % 5 AS country, n_name AS name, unnest([n_name, 'N' || (n_nationkey % 7)]) AS variant, n_nationkey FROM nation), v AS (SELECT *, variant = name || ' (N' || (n_nationkey % 7) || ')' AS f FROM n),
c AS (SELECT n_nationkey % 5 AS country, lower(unnest([n_name, 'N' || (n_nationkey % 7)])) AS label, 'Q' || n_nationkey AS qid FROM nation)
SELECT n.country::VARCHAR AS country, n.name || ' (N' || (n.n_nationkey % 7) || ')' AS name, min(qid) AS qid FROM n JOIN c ON n.country = c.country AND lower(n.variant) = c.label GROUP BY ALL HAVING count(DISTINCT qid) = 1""")
def j21(spark, d):
    """Outlets `NATION_3 (N3)`, whose entities are labelled by either name; several with one label resolve nothing."""
    n = t.table(spark, d, "nation").select(F.pmod("n_nationkey", F.lit(5)).cast("string").alias("country"), "n_name", F.concat(F.lit("N"), F.pmod("n_nationkey", F.lit(7))).alias("short"), F.concat(F.lit("Q"), "n_nationkey").alias("qid"))
    named = n.select("country", F.concat("n_name", F.lit(" ("), "short", F.lit(")")).alias("name"))
    return registry.resolve_entities(named, n.select("country", F.explode(F.array("n_name", "short")).alias("label"), "qid"))


@query("j22_first_listed", """WITH o AS (SELECT c_nationkey::VARCHAR AS country, c_mktsegment || ' ' || (c_custkey % 3) AS name, lower(c_mktsegment) || (c_custkey % 3) AS key, c_custkey AS priority FROM customer)
SELECT country, name, priority FROM o QUALIFY row_number() OVER (PARTITION BY country, key ORDER BY priority) = 1""")
def j22(spark, d):
    o = t.table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("country"), F.concat("c_mktsegment", F.lit(" "), F.pmod("c_custkey", F.lit(3))).alias("name"), F.col("c_custkey").alias("priority"))
    return registry.first_listed(o, spark.createDataFrame([], "country string, alias string, name string"))


@query("a18_hot_pages", f"""WITH {attention.EDITS}, b AS (SELECT wiki, title, count(DISTINCT user_hash) FILTER (NOT bot) AS editors, bool_or(created) AS created FROM edits WHERE seen_at > TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 2 HOUR AND seen_at <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY ALL)
SELECT * FROM b WHERE (editors >= 3 OR created) AND title <> 'click'""")
def a18(spark, d):
    noon = at("2024-01-20 12:00:00")
    cache = spark.createDataFrame([("en", "click")], "wiki string, title string").withColumn("checked_at", at("2024-01-19 00:00:00"))
    return facts.hot_pages(attention.edits(spark, d).filter(F.col("at") <= noon), cache, noon)


@query("j17_placed_activity", f"""WITH {attention.EDITS}, a AS (SELECT title, date_trunc('hour', seen_at) AS hour, count(*) AS edits, count(DISTINCT user_hash) FILTER (NOT bot) AS editors FROM edits GROUP BY ALL)
SELECT 'C' || length(title) AS country, strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, sum(edits)::BIGINT AS edits, sum(editors)::BIGINT AS editors FROM a GROUP BY 1, a.hour""")
def j17(spark, d):
    e = attention.edits(spark, d)
    pages = e.select("wiki", "title").distinct().withColumn("country", F.concat(F.lit("C"), F.length("title").cast("string")))
    return facts.placed_activity(rollup.page_activity(e), pages).withColumn("hour", stamp("hour"))


KINDS = ("usgs", "gdacs", "nws", "tsunami", "volcano", "firms", "ioda", "radar", "ucdp", "other")
#: Properties of every event, by its number and time; dates a little before and after the rules' limits.
PROPS = {
    "alert": ("['Green', 'Orange', NULL][(event_id % 3 + 1)::INT]", lambda h: F.element_at(F.array(F.lit("Green"), F.lit("Orange"), F.lit(None)), (F.col("event_id") % 3 + 1).cast("int"))),
    "severity": ("['Severe', 'Extreme', 'Minor'][(event_id % 3 + 1)::INT]", lambda h: F.element_at(F.array(F.lit("Severe"), F.lit("Extreme"), F.lit("Minor")), (F.col("event_id") % 3 + 1).cast("int"))),
    "category": ("['Information', 'Warning', NULL][(event_id % 3 + 1)::INT]", lambda h: F.element_at(F.array(F.lit("Information"), F.lit("Warning"), F.lit(None)), (F.col("event_id") % 3 + 1).cast("int"))),
    "detections": ("event_id % 100", lambda h: F.col("event_id") % 100),
    "modified": ("strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%SZ')", lambda h: h(1)), "expires": ("strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%SZ')", lambda h: h(9)),
    "seen": ("strftime(ts + INTERVAL 240 HOUR, '%Y-%m-%dT%H:%M:%SZ')", lambda h: h(240)), "last_seen": ("strftime(ts + INTERVAL 48 HOUR, '%Y-%m-%dT%H:%M:%SZ')", lambda h: h(48)),
    "end": ("CASE WHEN event_id % 7 > 0 THEN strftime(ts + INTERVAL 24 HOUR, '%Y-%m-%dT%H:%M:%SZ') END", lambda h: F.when(F.col("event_id") % 7 > 0, h(24))),
}


def ground_truth(spark, d):
    """Events as those of ten kinds of sources, of which every second is not news."""
    hours = lambda n: F.date_format(F.col("ts") + F.expr(f"interval {n} hours"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    e = t.table(spark, d, "events")
    rows = e.select("event_id", F.pmod("event_id", F.lit(20)).cast("int").alias("source_id"), F.concat(F.lit("x"), "event_id").alias("external_id"), F.col("ts").alias("added_at"), F.date_sub(F.to_date("ts"), F.pmod("event_id", F.lit(90)).cast("int")).alias("occurred_on"), F.when(F.col("event_id") % 4 == 2, "y").alias("superseded_by"), all_fields_json(*(f(hours).alias(k) for k, (_, f) in PROPS.items())).alias("props"))
    sources = spark.createDataFrame([(i, KINDS[i // 2], i % 2 == 1) for i in range(20)], "id int, kind string, attention boolean")
    return rows.filter(F.col("added_at") <= at(t.MIDDAY)), sources


NOW = f"TIMESTAMP '{t.MIDDAY}'"


def newer(value: str, hours: int) -> str:
    """The value, as a time, is less than so many hours before the moment t; a missing one is not."""
    return f"date_diff('microsecond', {value}::TIMESTAMP, t) < {hours} * 3600000000"


#: For each kind, the limits that a current and notable event keeps.
LIMITS = {
    "usgs": [newer("added_at", 72)],
    "tsunami": [newer("added_at", 24), "(category IS NULL OR category <> 'Information')"],
    "ucdp": ["date_diff('day', occurred_on, t::DATE) < 60"],
    "volcano": [newer("seen", 3)],
    "firms": [newer("last_seen", 24), "detections > 49"],
    "gdacs": [newer("modified", 24 * 30), "(alert IS NULL OR alert <> 'Green')"],
    "nws": [newer("expires", 0), "severity SIMILAR TO 'Severe|Extreme'", "superseded_by IS NULL"],
    "ioda": [newer('"end"', 3), newer("added_at", 48)],
    "radar": ["(" + newer('"end"', 3) + ' OR "end" IS NULL)'],
}
LIVE = f"""e AS (SELECT event_id, {list(KINDS)}[((event_id % 20) // 2 + 1)::INT] AS kind, event_id % 2 = 1 AS attention, ts AS added_at, ts::DATE - (event_id % 90)::INT AS occurred_on, CASE WHEN event_id % 4 = 2 THEN 'y' END AS superseded_by,
  {", ".join(f"{sql} AS {chr(34)}{k}{chr(34)}" for k, (sql, _) in PROPS.items())} FROM events WHERE ts <= {NOW}),
moments AS (SELECT *, {NOW} AS t FROM e WHERE attention = false), live AS (SELECT event_id, kind, added_at FROM moments JOIN ({" UNION ALL ".join(f"SELECT event_id AS held, '{kind}' AS by_kind FROM moments WHERE {' AND '.join(limits)}" for kind, limits in LIMITS.items())}) r ON r.held = event_id AND r.by_kind = kind)"""


@query("f22_live", f"WITH {LIVE} SELECT event_id, kind FROM live")
def f22(spark, d):
    return facts.live(*ground_truth(spark, d), at(t.MIDDAY)).select("event_id", "kind")


@query("f23_newest_live", f"WITH {LIVE} SELECT event_id FROM live WHERE kind <> 'usgs' OR added_at > {NOW} - INTERVAL 24 HOUR ORDER BY added_at DESC, 'x' || event_id LIMIT 5000")
def f23(spark, d):
    return facts.newest_live(facts.live(*ground_truth(spark, d), at(t.MIDDAY)), at(t.MIDDAY), hours=24).select("event_id")


@query("f20_legend", "SELECT o_orderkey AS k, ['verbal cooperation', 'material cooperation', 'verbal conflict', 'material conflict'][NULLIF(o_orderkey % 6, 0)] AS class, CASE o_custkey % 24 WHEN 14 THEN 'protest' WHEN 19 THEN 'fight' WHEN 4 THEN 'consult' END AS root FROM orders WHERE o_custkey % 24 IN (0, 4, 14, 19, 21)")
def f20(spark, d):
    """Names of codes; some codes have none."""
    from heliograph.functions import EVENT_ROOTS, QUAD_CLASSES, legend

    o = t.table(spark, d, "orders").filter((F.col("o_custkey") % 24).isin(0, 4, 14, 19, 21))
    return o.select(F.col("o_orderkey").alias("k"), legend((F.col("o_orderkey") % 6).cast("int"), QUAD_CLASSES).alias("class"), legend(F.lpad((F.col("o_custkey") % 24).cast("string"), 2, "0"), EVENT_ROOTS).alias("root"))


@query("f16_iso_to_fips", "SELECT c_custkey, CASE WHEN n_regionkey <> 2 THEN n_name END AS country FROM customer JOIN nation ON c_nationkey = n_nationkey")
def f16(spark, d):
    n = t.table(spark, d, "nation")
    codes = n.filter("n_regionkey <> 2").select(F.concat(F.lit("I"), "n_nationkey").alias("iso3"), F.col("n_name").alias("fips"))
    c = t.table(spark, d, "customer").select("c_custkey", F.concat(F.lit("I"), "c_nationkey").alias("iso3"))
    return facts.to_fips(c, codes, "iso3").select("c_custkey", "country")


@query("j14_superseded", "SELECT o.o_orderkey AS k, max_by(x.o_orderkey, (x.o_orderdate, x.o_orderkey)) AS by_k FROM orders o JOIN orders x ON x.o_orderkey IN (o.o_orderkey + 1, o.o_orderkey + 2) GROUP BY 1")
def j14(spark, d):
    o = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("external_id"), F.col("o_orderdate").alias("added_at"), F.array(F.col("o_orderkey") - 1, F.col("o_orderkey") - 2).alias("refs"))
    return facts.superseded(o).select(F.col("external_id").alias("k"), F.col("superseded_by").alias("by_k")).filter("by_k is not null")


BOXES = "shape AS (SELECT 'S' || x || '_' || y AS code, x * 0.2 - 0.4 AS x1, y * 0.2 - 0.4 AS y1 FROM range(4) a(x), range(4) b(y) WHERE (x + y) % 2 = 0)"
POINTS = "point AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS lon, embedding[2]::DOUBLE AS lat FROM embeddings)"


def points(spark, d):
    return t.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("lon"), F.col("embedding")[1].cast("double").alias("lat"))


def boxes(spark):
    ring = lambda x, y: [[{"x": a, "y": b} for a, b in ((x, y), (x + 0.2, y), (x + 0.2, y + 0.2), (x, y + 0.2))]]
    return spark.createDataFrame([(f"S{i}_{j}", [ring(i * 0.2 - 0.4, j * 0.2 - 0.4)]) for i in range(4) for j in range(4) if (i + j) % 2 == 0], f"code string, geom {geo.SHAPE}")


@query("j09_point_in_polygon", f"WITH {BOXES}, {POINTS} SELECT id, code FROM point JOIN shape ON lon >= x1 AND lon < x1 + 0.2 AND lat >= y1 AND lat < y1 + 0.2")
def j09(spark, d):
    return geo.containing(points(spark, d), boxes(spark), 0.1)


@query("g02_density_clusters", f"""WITH RECURSIVE {POINTS}, e AS (SELECT a.id AS a, b.id AS b FROM point a JOIN point b ON sqrt((a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat)) <= 0.012),
r(id, root) AS (SELECT id, id FROM point UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id) SELECT id, min(root) AS cluster FROM r GROUP BY id""")
def g02(spark, d):
    p = points(spark, d)
    return geo.density_clusters(p.select("id", F.col("lon").alias("x"), F.col("lat").alias("y")), 0.012)


@query("g05_sphere_distance", f"WITH {POINTS} SELECT id, round(2 * 6371.0088 * asin(least(1, sqrt(pow(sin(radians(10 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(10)) * pow(sin(radians(20 - lon) / 2), 2)))), 6) AS km FROM point")
def g05(spark, d):
    from heliograph.functions import sphere_km

    return points(spark, d).select("id", F.round(sphere_km(F.col("lon"), F.col("lat"), F.lit(20.0), F.lit(10.0)), 6).alias("km"))


@query("g01_hull_areas", """WITH p AS (SELECT DISTINCT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
way AS (SELECT a.label, a.x, a.y, atan2(b.y - a.y, b.x - a.x) AS t FROM p a JOIN p b ON a.label = b.label AND (a.x <> b.x OR a.y <> b.y)),
turn AS (SELECT label, x, y, coalesce(lead(t) OVER w, min(t) OVER (PARTITION BY label, x, y) + 2 * pi()) - t AS free FROM way WINDOW w AS (PARTITION BY label, x, y ORDER BY t)),
corner AS (SELECT label, x, y FROM turn GROUP BY label, x, y HAVING max(free) > pi()),
ring AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY atan2(y - cy, x - cx)) AS k, count(*) OVER (PARTITION BY label) AS n FROM (SELECT *, avg(x) OVER (PARTITION BY label) AS cx, avg(y) OVER (PARTITION BY label) AS cy FROM corner))
SELECT a.label, count(*)::INT AS corners, round(abs(sum((radians(b.x) - radians(a.x)) * (2 + sin(radians(a.y)) + sin(radians(b.y))))) / 2 * 6371.0088 * 6371.0088, 6) AS area_km2
FROM ring a JOIN ring b ON a.label = b.label AND b.k = a.k % a.n + 1 GROUP BY a.label""")
def g01(spark, d):
    p = t.table(spark, d, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return geo.hulls(p, "label").select("label", F.size("hull").alias("corners"), F.round("area_km2", 6).alias("area_km2"))


@query("a14_weighted_centroid", "SELECT c_nationkey AS division, round(sum(c_custkey * greatest(c_acctbal, 1)) / sum(greatest(c_acctbal, 1)), 6) AS lon, round(sum((c_custkey % 90) * greatest(c_acctbal, 1)) / sum(greatest(c_acctbal, 1)), 6) AS lat FROM customer GROUP BY 1")
def a14(spark, d):
    from heliograph.operators.gazetteer import weighted_centroid

    c = t.table(spark, d, "customer").select(F.col("c_nationkey").alias("division"), F.col("c_custkey").cast("double").alias("lon"), F.pmod("c_custkey", F.lit(90)).cast("double").alias("lat"), F.col("c_acctbal").alias("population"))
    return weighted_centroid(c, "division").select("division", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


#: Names of one to four words: what documents begin with, of letters of one script and one space between them.
HEAD = "^([A-Z][A-Za-z]+(?: [A-Za-z]+){%d})(?:[^\\p{L}\\p{N} ]| [^\\p{L}\\p{N}]|$| )"


def head_names(spark, d):
    heads = F.array(*(F.regexp_extract("text", HEAD % n, 1) for n in range(4)))
    return t.table(spark, d, "documents").select(F.explode(heads).alias("name")).filter("name <> ''").distinct().withColumn("place_id", F.xxhash64("name"))


NAMED = """WITH names AS (SELECT DISTINCT unnest([""" + ", ".join(f"regexp_extract(text, '{HEAD % n}', 1)" for n in range(4)) + """]) AS name FROM documents), named AS (SELECT name FROM names WHERE name <> ''),
every AS (SELECT '(?:^|[^\\p{L}\\p{N}])(' || string_agg(replace(name, ' ', '  '), '|' ORDER BY length(name) DESC, name) || ')(?:[^\\p{L}\\p{N}]|$)' AS p FROM named),
m AS (SELECT doc_id, replace(unnest(regexp_extract_all(regexp_replace(text, '([^\\p{L}\\p{N}])', '\\1\\1', 'g'), p, 1)), '  ', ' ') AS name FROM documents, every)
SELECT doc_id, name, count(*) AS hits FROM m GROUP BY ALL"""


def hits_by_name(spark, d, match):
    names = checkpointed(head_names(spark, d))  # the documents are read once for them
    texts = t.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return match(texts, names).join(names, "place_id").groupBy(F.col("id").alias("doc_id"), "name").agg(F.count("*").alias("hits"))


@query("j19_gazetteer_match", NAMED)
def j19(spark, d):
    """By one automaton over all names."""
    from heliograph.operators.gazetteer import match_names

    return hits_by_name(spark, d, match_names)


@query("j19_gazetteer_grams", NAMED)
def j19_grams(spark, d):
    """By n-grams, as for more names than a worker holds."""
    from heliograph.operators.gazetteer import match_by_grams

    return hits_by_name(spark, d, match_by_grams)


@query("j20_name_to_place", "SELECT c_mktsegment AS name, c_custkey AS place_id FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey % 3, c_acctbal DESC, c_custkey) = 1")
def j20(spark, d):
    from heliograph.operators.gazetteer import one_place_per_name

    kind = F.element_at(F.array(F.lit("country"), F.lit("city"), F.lit("division")), F.pmod("c_nationkey", F.lit(3)) + 1)
    n = t.table(spark, d, "customer").select(F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("place_id"), kind.alias("kind"), F.col("c_acctbal").alias("population"))
    return one_place_per_name(n).select("name", "place_id")


@query("w05_first_per_hour", "SELECT event_type AS place_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) <= 2")
def w05(spark, d):
    from heliograph.operators.gazetteer import first_pointers

    e = t.table(spark, d, "events").select(F.col("event_type").alias("place_id"), F.col("ts").alias("at"), F.col("event_id").alias("uri"))
    return first_pointers(e, 2).select("place_id", stamp("hour").alias("hour"), F.col("uri").alias("event_id"))


@query("j18_chatter_countries", "SELECT n_name AS country, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS posts FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def j18(spark, d):
    from heliograph.operators.gazetteer import chatter_countries

    posts = t.table(spark, d, "events").groupBy(F.col("user_id").alias("place_id"), F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("posts"))
    c, n = t.table(spark, d, "customer"), t.table(spark, d, "nation")
    places = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("place_id"), F.col("n_name").alias("country"))
    return chatter_countries(posts, places).withColumn("hour", stamp("hour"))


NAMES = "names AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}')) AS name FROM documents)"


@query("a20_stop_names", f"""WITH {NAMES}, w AS (SELECT tok, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS tok FROM documents) GROUP BY tok),
g AS (SELECT n.name, coalesce(sum(w.n) FILTER (tok = n.name), 0)::BIGINT AS cap, coalesce(sum(w.n) FILTER (tok <> n.name AND tok = lower(n.name)), 0)::BIGINT AS low FROM names n JOIN w ON lower(n.name) = lower(tok) GROUP BY 1)
SELECT name, cap, low FROM g WHERE low >= greatest(cap, 1) AND low + cap >= 3""")
def a20(spark, d):
    from heliograph.operators.gazetteer import stop_names

    docs = t.table(spark, d, "documents").select("text")
    return stop_names(docs, docs.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{3,}"), F.lit(0))).alias("name")).distinct())


@query("u11_due_days", "SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderdate < DATE '2001-08-01' - INTERVAL 35 DAY")
def u11(spark, d):
    from heliograph.operators.archive import due_days

    return due_days(t.table(spark, d, "orders"), "o_orderdate", F.lit("2001-08-01 13:00:00").cast("timestamp_ntz"), 35).select(F.col("day").cast("string").alias("day"))
