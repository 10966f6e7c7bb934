"""Stories: growth of events, ranking after collapsing syndicated headlines, and the list of headlines to fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.functions import norm_title


def event_growth(mention: DataFrame, event: DataFrame, as_of: Column) -> DataFrame:
    """Events with mentions in the last six hours: their first counts, and mentions and distinct outlets of one hour and of six.
    Mentions are counted per event and outlet first, so distinct outlets need no second pass."""
    recent = mention.filter((F.col("mentioned_at") > as_of - F.expr("interval 6 hours")) & (F.col("mentioned_at") <= as_of))
    hour = F.col("mentioned_at") > as_of - F.expr("interval 1 hour")
    per_outlet = recent.groupBy("event_id", "source_name").agg(F.count("*").alias("n6"), F.count_if(hour).alias("n1"))
    counts = per_outlet.groupBy("event_id").agg(F.sum("n1").alias("mentions_1h"), F.count_if((F.col("n1") > 0) & F.col("source_name").isNotNull()).alias("sources_1h"), F.sum("n6").alias("mentions_6h"), F.count("source_name").alias("sources_6h"))
    first = event.select(F.col("id").alias("event_id"), "url", "added_at", F.col("num_sources").alias("first_sources"), F.col("num_mentions").alias("first_mentions"))
    return first.join(counts, "event_id")


def keyed_events(event: DataFrame, story: DataFrame) -> DataFrame:
    """Events with the key of their story: the normal title of their page, else the link, else the id; and the page's site."""
    titles = story.filter("status = 'ok'").select("url", "title", "site")
    key = F.coalesce(norm_title(F.col("title")), F.col("url"), F.col("id").cast("string"))
    return event.join(titles, "url", "left").select(F.col("id").alias("event_id"), "site", key.alias("skey"))


def top_stories(mention: DataFrame, event: DataFrame, story: DataFrame, as_of: Column, hours: int = 24, limit: int | None = 20) -> DataFrame:
    """Stories of the window by outlets, then outlets of the last hour, then key: skey, rep (the most mentioned event, of equals the
    least id), outlets, outlets_1h, mentions and sites. Mentions are counted per story and outlet first, so distinct outlets need no
    second pass."""
    recent = mention.filter((F.col("mentioned_at") > as_of - F.expr(f"interval {hours} hours")) & (F.col("mentioned_at") <= as_of))
    per_event = recent.groupBy("event_id", "source_name").agg(F.count("*").alias("n"), F.max("mentioned_at").alias("last"))
    rows = per_event.join(keyed_events(event, story), "event_id")
    size = rows.groupBy("skey", "event_id", "site").agg(F.sum("n").alias("m"))
    lead = size.groupBy("skey").agg(F.min_by("event_id", F.struct((-F.col("m")).alias("m"), "event_id")).alias("rep"), F.count_distinct("site").alias("sites"))
    per_outlet = rows.groupBy("skey", "source_name").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    late = (F.col("last") > as_of - F.expr("interval 1 hour")) & F.col("source_name").isNotNull()
    counts = per_outlet.groupBy("skey").agg(F.count("source_name").alias("outlets"), F.count_if(late).alias("outlets_1h"), F.sum("n").alias("mentions"))
    out = counts.join(lead, "skey").select("skey", "rep", "outlets", "outlets_1h", "mentions", "sites")
    return out if limit is None else out.orderBy(F.desc("outlets"), F.desc("outlets_1h"), "skey").limit(limit)


def with_headline(top: DataFrame, event: DataFrame, story: DataFrame) -> DataFrame:
    """The ranked stories with their leading event's place and headline, in order again."""
    shown = event.select(F.col("id").alias("rep"), "url", "country")
    titles = story.filter("status = 'ok'").select("url", "title")
    return top.join(shown, "rep", "left").join(titles, "url", "left").orderBy(F.desc("outlets"), F.desc("outlets_1h"), "skey")


def headline_worklist(event: DataFrame, mention: DataFrame, story: DataFrame, as_of: Column, hours: int = 24, least: int = 2, attempts: int = 3, retry_hours: int = 6, limit: int = 2000) -> DataFrame:
    """Links worth fetching, those with most sources first: the larger of an event's own source count and of the link's outlets in
    the window, at least `least`, not fetched yet or failed and due again; `limit` of them a run."""
    since = as_of - F.expr(f"interval {hours} hours")
    linked = event.filter(F.col("url").isNotNull())
    first = linked.filter(F.col("added_at") > since).select("url", F.col("num_sources").cast("long").alias("n"))
    # Once an event and outlet, then once a link and outlet.
    seen = mention.filter(F.col("mentioned_at") > since).select("event_id", "source_name").distinct()
    later = seen.join(linked.select(F.col("id").alias("event_id"), "url"), "event_id").groupBy("url").agg(F.count_distinct("source_name").alias("n"))
    best = first.unionByName(later).groupBy("url").agg(F.max("n").alias("sources")).filter(F.col("sources") >= least)
    known = story.select("url", "status", "attempts", "fetched_at")
    due = F.col("status").isNull() | ((F.col("status") == "fail") & (F.col("attempts") < attempts) & (F.col("fetched_at") < as_of - F.expr(f"interval {retry_hours} hours")))
    return best.join(known, "url", "left").filter(due).orderBy(F.desc("sources"), "url").limit(limit).select("url", "sources")
