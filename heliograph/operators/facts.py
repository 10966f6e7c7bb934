"""Themes, source health, gaps of file series, live rules of alerts, supersession and hot pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def theme_counts(article: DataFrame, location: DataFrame, kinds: bool = True) -> DataFrame:
    """Articles per region, theme and day: once an article, however often it names the place; adm1 only where known."""
    country = location.filter("country is not null").select("article_id", F.lit("country").alias("region_kind"), F.col("country").alias("region"))
    adm1 = location.filter("adm1 is not null").select("article_id", F.lit("adm1").alias("region_kind"), F.col("adm1").alias("region"))
    places = (country.union(adm1) if kinds else country).distinct()
    themes = article.select("article_id", F.to_date("added_at").alias("day"), F.date_trunc("hour", "added_at").alias("hour"), F.explode(F.array_distinct("themes")).alias("theme"))
    return themes.join(places, "article_id")


def theme_daily(article: DataFrame, location: DataFrame) -> DataFrame:
    return theme_counts(article, location).groupBy("region_kind", "region", "theme", "day").agg(F.count("*").alias("articles"))


def theme_hourly(article: DataFrame, location: DataFrame) -> DataFrame:
    """Countries only."""
    return theme_counts(article, location, kinds=False).groupBy("region", "theme", "hour").agg(F.count("*").alias("articles"))


def source_health(sources: DataFrame, fetch_log: DataFrame, as_of: Column, slack: int = 3) -> DataFrame:
    """Of each source: last fetch, last with rows, fetches and rows of a day, and whether it is enabled and nothing came for
    `slack` times its cadence. sources has expect_every, the cadence in seconds."""
    own = F.col("fetched_at") > as_of - F.expr("interval 24 hours")
    log = fetch_log.groupBy("source_id").agg(
        F.max("fetched_at").alias("last_fetch"), F.max(F.when(F.col("rows_kept") > 0, F.col("fetched_at"))).alias("last_rows"),
        F.count_if(own).alias("fetches_24h"), F.sum(F.when(own, F.col("rows_kept")).otherwise(0)).alias("rows_24h"),
    )
    late = F.col("last_rows").isNull() | (F.col("last_rows") < as_of - F.make_dt_interval(secs=F.col("expect_every") * slack))
    both = sources.join(log, sources["id"] == log["source_id"], "left")
    return both.select("name", "kind", "enabled", "expect_every", "last_fetch", "last_rows", F.coalesce("fetches_24h", F.lit(0)).alias("fetches_24h"), F.coalesce("rows_24h", F.lit(0)).alias("rows_24h"), (F.col("enabled") & late).alias("stale"))


def expected_slots(spark, since: str, until: str, minutes: int = 15) -> DataFrame:
    """Every slot start of a file series from since to until."""
    step = f"interval {minutes} minutes"
    return spark.range(1).select(F.explode(F.expr(f"sequence(timestamp_ntz '{since}', timestamp_ntz '{until}', {step})")).alias("slot"))


def gaps(slots: DataFrame, loaded: DataFrame) -> DataFrame:
    """Slots without a file: a gap is a missing row of the ledger."""
    return slots.join(loaded.select("slot").distinct(), "slot", "left_anti")


def unloaded(files: DataFrame, fetch_log: DataFrame) -> DataFrame:
    return files.join(fetch_log.select("source_id", "file"), ["source_id", "file"], "left_anti")


def active_sources(sources: DataFrame, names: list[str]) -> DataFrame:
    """Sources of some names that are enabled."""
    return sources.filter(F.col("name").isin(*names) & F.col("enabled"))


def prop(name: str, kind: str = "string") -> Column:
    return F.get_json_object("props", f"$.{name}").try_cast(kind)


def ago(as_of: Column, what: str) -> Column:
    return as_of - F.expr(f"interval {what}")


def moment(name: str) -> Column:
    """A property with a time; one without a zone is UTC."""
    return prop(name, "timestamp")


#: For each kind of source, which of its events are current and notable at a moment.
LIVE_RULES = {
    "usgs": lambda now: F.col("added_at") > ago(now, "72 hours"),
    "gdacs": lambda now: ~prop("alert").eqNullSafe("Green") & (moment("modified") > ago(now, "30 days")),
    "nws": lambda now: F.col("superseded_by").isNull() & (moment("expires") > now) & prop("severity").isin("Severe", "Extreme"),
    "tsunami": lambda now: ~prop("category").eqNullSafe("Information") & (F.col("added_at") > ago(now, "24 hours")),
    "volcano": lambda now: moment("seen") > ago(now, "3 hours"),
    "firms": lambda now: (prop("detections", "int") >= 50) & (moment("last_seen") > ago(now, "24 hours")),
    "ioda": lambda now: (moment("end") > ago(now, "3 hours")) & (F.col("added_at") > ago(now, "48 hours")),
    "radar": lambda now: prop("end").isNull() | (moment("end") > ago(now, "3 hours")),
    "ucdp": lambda now: F.col("occurred_on") > F.date_sub(F.to_date(now), 60),
}


def live(events: DataFrame, sources: DataFrame, as_of: Column, rules: dict = LIVE_RULES) -> DataFrame:
    """Events, with the kind of their source, for which that kind's rule holds; an unknown kind has none, and sources
    that count for attention are left out. sources has id, kind and attention."""
    now = as_of.cast("timestamp")
    placed = events.join(sources.filter(~F.col("attention")).select(F.col("id").alias("source_id"), "kind"), "source_id")
    held = None
    for kind, rule in rules.items():
        held = F.when(F.col("kind") == kind, rule(now)) if held is None else held.when(F.col("kind") == kind, rule(now))
    return placed.filter(F.coalesce(held.otherwise(False), F.lit(False)))


def newest_live(rows: DataFrame, as_of: Column, narrowed: str = "usgs", hours: int = 72, limit: int = 5000) -> DataFrame:
    """Live events, newest first, those of one kind only of the last `hours`."""
    return rows.filter((F.col("kind") != narrowed) | (F.col("added_at") > ago(as_of, f"{hours} hours"))).orderBy(F.desc("added_at"), "external_id").limit(limit)


def last_referrer(alerts: DataFrame) -> DataFrame:
    """(external_id, superseded_by): of the messages that refer to an alert the latest one, of equals the greatest id."""
    refers = alerts.select(F.explode("refs").alias("external_id"), F.struct("added_at", F.col("external_id").alias("by")).alias("b"))
    return refers.groupBy("external_id").agg(F.max("b").alias("b")).select("external_id", F.col("b.by").alias("superseded_by"))


def superseded(alerts: DataFrame) -> DataFrame:
    """alerts with superseded_by, null where no other refers to them."""
    return alerts.drop("superseded_by").join(last_referrer(alerts), "external_id", "left")


def hot_pages(edits: DataFrame, cache: DataFrame, as_of: Column, editors: int = 3, limit: int = 200) -> DataFrame:
    """Pages worth placing: enough human editors in two hours, or new ones, that were not looked up for a week."""
    recent = edits.filter(F.col("at") > ago(as_of, "2 hours"))
    busy = recent.groupBy("wiki", "title").agg(F.count_distinct(F.when(~F.col("bot"), F.col("user_hash"))).alias("editors"), F.bool_or("created").alias("created")).filter((F.col("editors") >= editors) | F.col("created"))
    known = cache.filter(F.col("checked_at") > ago(as_of, "7 days")).select("wiki", "title")
    return busy.join(known, ["wiki", "title"], "left_anti").orderBy(F.desc("editors"), "wiki", "title").limit(limit)


def placed_activity(activity: DataFrame, pages: DataFrame) -> DataFrame:
    """Edits per country and hour of pages that have a place."""
    return activity.join(pages.filter("country is not null").select("wiki", "title", "country"), ["wiki", "title"]).groupBy("country", "hour").agg(F.sum("edits").alias("edits"), F.sum("editors").alias("editors"))


def to_fips(rows: DataFrame, codes: DataFrame, iso3: str) -> DataFrame:
    """rows with `country`; those of unknown codes have null there, to be counted before they are dropped."""
    return rows.join(F.broadcast(codes.select(F.col("iso3").alias(iso3), F.col("fips").alias("country"))), iso3, "left")
