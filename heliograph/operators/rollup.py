"""Attention series: sightings and coverage per place and hour, days, baselines, and the job that keeps them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.functions import z_score

KEY = ["region_kind", "region", "hour"]


def regions() -> Column:
    """Both kinds of region of an event in one pass; a blank region is none."""
    return F.explode(F.array(F.struct(F.lit("country").alias("region_kind"), F.col("country").alias("region")), F.struct(F.lit("adm1").alias("region_kind"), F.col("adm1").alias("region"))))


def by_region(rows: DataFrame, *columns: str | Column) -> DataFrame:
    return rows.select(*columns, regions().alias("r")).select("*", "r.*").drop("r").filter(F.col("region").isNotNull() & (F.col("region") != ""))


def hourly_sightings(event: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """First sightings per region and hour, of sources that count for attention (all without `sources`)."""
    if sources is not None:
        event = event.join(sources.filter("attention").select(F.col("id").alias("source_id")), "source_id", "left_semi")
    rows = by_region(event, F.date_trunc("hour", "added_at").alias("hour"))
    return rows.groupBy(*KEY).agg(F.count("*").alias("events"))


def hourly_coverage(mention: DataFrame, event: DataFrame) -> DataFrame:
    """Mentions and distinct outlets per region and hour. A place's hour is counted per outlet first, so that
    one busy place is spread over its outlets."""
    seen = mention.select("event_id", F.date_trunc("hour", "mentioned_at").alias("hour"), "source_name").join(event.select(F.col("id").alias("event_id"), "country", "adm1"), "event_id")
    per_outlet = by_region(seen, "hour", "source_name").groupBy(*KEY, "source_name").agg(F.count("*").alias("n"))
    return per_outlet.groupBy(*KEY).agg(F.sum("n").alias("mentions"), F.count("source_name").alias("sources"))


def attention_hourly(sightings: DataFrame, coverage: DataFrame) -> DataFrame:
    """Both measures side by side, 0 where one is absent."""
    both = sightings.join(coverage, KEY, "full_outer")
    return both.select(*KEY, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("events", "mentions", "sources")))


def attention_daily(hourly: DataFrame) -> DataFrame:
    """Sums of the hours of a UTC day; sources too are the sum of hourly counts."""
    return hourly.groupBy("region_kind", "region", F.to_date("hour").alias("day")).agg(*(F.sum(c).alias(c) for c in ("events", "mentions", "sources")))


def mention_hourly(mention: DataFrame) -> DataFrame:
    return mention.groupBy("event_id", F.date_trunc("hour", "mentioned_at").alias("hour")).agg(F.count("*").alias("mentions"), F.count_distinct("source_name").alias("sources"))


def page_activity(edits: DataFrame) -> DataFrame:
    """Edits, distinct human editors and whether the page was created, per page and hour."""
    human = F.when(~F.col("bot"), F.col("user_hash"))
    return edits.groupBy("wiki", "title", F.date_trunc("hour", "at").alias("hour")).agg(F.count("*").alias("edits"), F.count_distinct(human).alias("editors"), F.bool_or("created").alias("created"))


def chatter_hourly(five_minute: DataFrame) -> DataFrame:
    return five_minute.groupBy("source", "place_id", F.date_trunc("hour", "bucket").alias("hour")).agg(F.sum("posts").alias("posts"))


def region_names(event: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """The most common name of each country in recent events that are placed by country (geo_type 1), of equals the least."""
    recent = event.filter((F.col("geo_type") == 1) & F.col("geo_name").isNotNull() & (F.col("added_at") > as_of - F.expr(f"interval {days} days")))
    return recent.groupBy(F.lit("country").alias("region_kind"), F.col("country").alias("region")).agg(F.mode("geo_name", True).alias("name"))


def seasonal_baseline(hourly: DataFrame, days: int = 30) -> DataFrame:
    """baseline_mean, baseline_sd and z of each hour with a row, against the same hour of the `days` days before;
    a day without a row counts as 0. One shuffle by place and hour of day, sums in whole numbers."""
    hour_no = F.floor(F.unix_timestamp(F.col("hour").cast("timestamp")) / 3600)
    before = Window.partitionBy("region_kind", "region", F.col("slot")).orderBy("day_no").rangeBetween(-days, -1)
    m = F.col("mentions").cast("long")
    placed = hourly.withColumn("slot", F.pmod(hour_no, F.lit(24))).withColumn("day_no", F.floor(hour_no / 24).cast("long"))
    sums = placed.select("*", F.coalesce(F.sum(m).over(before), F.lit(0)).alias("s1"), F.coalesce(F.sum(m * m).over(before), F.lit(0)).alias("s2"))
    scored = sums.withColumn("baseline_mean", F.col("s1") / days).withColumn("baseline_sd", F.sqrt((days * F.col("s2") - F.col("s1") * F.col("s1")).cast("double")) / days)
    return scored.withColumn("z", z_score(m, F.col("baseline_mean"), F.col("baseline_sd"))).drop("slot", "day_no", "s1", "s2")


def first_whole_hour(oldest: Column) -> Column:
    """The buffer's first hour that cannot have lost rows."""
    floor = F.date_trunc("hour", oldest)
    return F.when(floor == oldest, floor).otherwise(floor + F.expr("interval 1 hour"))


def recomputed(base: DataFrame, new: DataFrame, since: Column, keys: list[str] = KEY, measures: tuple[str, ...] = ("events", "mentions", "sources"), time: str = "hour") -> DataFrame:
    """base with the rows of new from `since` on; a measure that new lacks keeps its stored value."""
    own = [c for c in measures if c in new.columns]
    recent = new.filter(F.col(time) >= since).select(*keys, *(F.col(c).alias(f"new_{c}") for c in own))
    merged = base.join(recent, keys, "full_outer")
    return merged.select(*keys, *(F.coalesce(*([F.col(f"new_{c}")] if c in own else []), F.col(c), F.lit(0)).alias(c) for c in measures))


def incremental(hourly: DataFrame, event: DataFrame, mention: DataFrame, as_of: Column, hours: int = 48) -> DataFrame:
    """The series after a run: sightings of the last `hours` hours counted anew, and coverage of those whole hours
    that the mention buffer still has; older hours stay as they were."""
    since = F.date_trunc("hour", as_of - F.expr(f"interval {hours} hours"))
    oldest = mention.agg(F.min("mentioned_at").alias("t")).select(first_whole_hour(F.col("t")).alias("t")).first()["t"]
    out = recomputed(hourly, hourly_sightings(event.filter(F.col("added_at") >= since)), since)
    if oldest is None:
        return out
    start = F.greatest(since, F.lit(oldest))
    return recomputed(out, hourly_coverage(mention.filter(F.col("mentioned_at") >= start), event), start)


def full_since(event: DataFrame, as_of: Column, window_days: int = 35) -> DataFrame:
    """Where a full run begins: the first sighting, but not before the hot window, so archived hours stay."""
    return event.agg(F.min("added_at").alias("first")).select(F.greatest("first", F.date_trunc("day", as_of) - F.expr(f"interval {window_days} days")).alias("since"))
