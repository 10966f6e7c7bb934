"""Share of the world's attention, forecasts, freshness, and the series that a reader asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_share(daily: DataFrame) -> DataFrame:
    """Mentions as a share of all mentions of the day (and kind of region). Totals are a row a day and kind."""
    world = daily.groupBy("region_kind", "day").agg(F.greatest(F.sum("mentions"), F.lit(1)).alias("world"))
    return daily.join(world, ["region_kind", "day"]).withColumn("share", F.col("mentions") / F.col("world")).drop("world")


def current_totals(hourly: DataFrame, anomaly: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Each region's mentions and greatest hourly z in the window, and the world's mentions, 1 at least."""
    recent = hourly.filter((F.col("hour") > as_of - F.expr(f"interval {hours} hours")) & (F.col("hour") <= as_of))
    peaks = anomaly.filter((F.col("hour") > as_of - F.expr(f"interval {hours} hours")) & (F.col("hour") <= as_of)).groupBy("region_kind", "region").agg(F.max("z").alias("peak_z"))
    own = recent.groupBy("region_kind", "region").agg(F.sum("mentions").alias("mentions"))
    world = own.groupBy("region_kind").agg(F.greatest(F.sum("mentions"), F.lit(1)).alias("world"))
    return own.join(peaks, ["region_kind", "region"], "left").join(world, "region_kind")


def share_score(hourly: DataFrame, daily: DataFrame, anomaly: DataFrame, names: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """z of a region's share of the last 24 hours against its daily shares of the days before, with the mentions that its mean share
    lets expect, its name and its greatest hourly z. Days without a row do not count; sd has the floor of a binomial share, and of
    one mention."""
    day = F.to_date(as_of)
    past = daily_share(daily.filter((F.col("day") < day) & (F.col("day") >= F.date_sub(day, days))))
    usual = past.groupBy("region_kind", "region").agg(F.avg("share").alias("mean"), F.stddev_pop("share").alias("sd"))
    key = ["region_kind", "region"]
    now = current_totals(hourly, anomaly, as_of).join(usual, key, "left").join(names, key, "left")
    share, mean = F.col("mentions") / F.col("world"), F.coalesce("mean", F.lit(0.0))
    floor = F.greatest(F.coalesce("sd", F.lit(0.0)), F.sqrt(mean / F.col("world")), 1 / F.col("world"))
    # Six places first, so that a sum's last bit does not decide a half.
    return now.select(*key, "name", "mentions", F.round(F.round(mean * F.col("world"), 6)).cast("long").alias("expected"), ((share - mean) / floor).alias("z"), "peak_z")


def top_regions(scored: DataFrame, least: int = 50, limit: int = 8) -> DataFrame:
    return scored.filter(F.col("mentions") >= least).orderBy(F.desc("z"), "region_kind", "region", F.desc("hour")).limit(limit)


def region_series(daily: DataFrame, kind: str, region: str, as_of: Column, days: int = 30) -> DataFrame:
    own = (F.col("region_kind") == kind) & (F.col("region") == region) & (F.col("day") > F.date_sub(F.to_date(as_of), days)) & (F.col("day") <= F.to_date(as_of))
    return daily.filter(own).orderBy("day")


def forecast_sum(forecast: DataFrame, fetch_log: DataFrame, sources: DataFrame, as_of: Column, months: int = 1, source: str = "views-forecast", prefix: str = "fatalities") -> DataFrame:
    """Fatalities over the next months and the largest probability, of each country in the run that was fetched last."""
    own = fetch_log.join(sources.filter(F.col("name") == source).select(F.col("id").alias("source_id")), "source_id", "left_semi").filter(F.col("file").startswith(prefix))
    newest = own.agg(F.max_by("file", F.struct("fetched_at", "file")).alias("run"))
    first = F.trunc(as_of, "MM")
    ahead = (F.col("month") >= first) & (F.col("month") < F.add_months(first, months))
    return forecast.join(newest, "run").filter(ahead).groupBy("country", "run").agg(F.sum("fatalities").alias("fatalities"), F.max("p_any").alias("p_any"))


def freshness(fetch_log: DataFrame, sources: DataFrame, kind: str) -> DataFrame:
    own = sources.filter(F.col("kind") == kind).select(F.col("id").alias("source_id"))
    return fetch_log.join(own, "source_id", "left_semi").agg(F.max("fetched_at").alias("newest"))
