"""The hourly job: all series of a window counted anew, then old rows archived and buffers pruned.

Tables are DataFrames by name; a run returns those it changed, to be written as new versions of the touched days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.shared import checkpointed

from . import archive, publish, rollup, upsert

HOURS, BASELINE_DAYS, HOT_DAYS = 48, 30, 35
#: How long buffers without an archive keep rows: the time column and an interval.
BUFFERS = {"mention": ("mentioned_at", "72 hours"), "wiki_edit": ("at", "72 hours"), "chatter_5min": ("bucket", "7 days"), "bsky_uri": ("at", "48 hours"), "attention_anomaly": ("hour", "7 days")}


def replaced(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return upsert.merge(base, new.select(*base.columns), keys)


def buffered_since(buffer: DataFrame, time: str, since: Column) -> Column | None:
    """The later of since and the first whole hour of a buffer; None for an empty one."""
    first = buffer.agg(F.min(time).alias("t")).select(rollup.first_whole_hour(F.col("t")).alias("t")).first()["t"]
    return None if first is None else F.greatest(since, F.lit(first).cast(buffer.schema[time].dataType))


def rolled_up(tables: dict[str, DataFrame], as_of: Column, since: Column, scores: bool = True) -> dict[str, DataFrame]:
    """tables with the rows from the hour of since on counted anew: hours, days and, with scores, anomalies and names."""
    t = dict(tables)
    since = F.date_trunc("hour", since)
    event = t["event"].filter(F.col("added_at") >= since)
    hourly = rollup.recomputed(t["attention_hourly"], rollup.hourly_sightings(event, t.get("source")), since)
    mentioned = buffered_since(t["mention"], "mentioned_at", since)
    if mentioned is not None:
        recent = t["mention"].filter(F.col("mentioned_at") >= mentioned)
        hourly = rollup.recomputed(hourly, rollup.hourly_coverage(recent, t["event"]), mentioned)
        t["mention_hourly"] = replaced(t["mention_hourly"], rollup.mention_hourly(recent), ["event_id", "hour"])
    edited = buffered_since(t["wiki_edit"], "at", since)
    if edited is not None:
        t["wiki_activity"] = replaced(t["wiki_activity"], rollup.page_activity(t["wiki_edit"].filter(F.col("at") >= edited)), ["wiki", "title", "hour"])
    t["chatter_hourly"] = replaced(t["chatter_hourly"], rollup.chatter_hourly(t["chatter_5min"].filter(F.col("bucket") >= since)), ["source", "place_id", "hour"])
    hourly = t["attention_hourly"] = checkpointed(hourly)  # read by days, scores and the writer
    days = rollup.attention_daily(hourly.filter(F.col("hour") >= F.date_trunc("day", since)))
    t["attention_daily"] = replaced(t["attention_daily"], days, ["region_kind", "region", "day"])
    if scores:
        # Only the days under the window's baselines are read.
        under = hourly.filter(F.col("hour") >= since - F.expr(f"interval {BASELINE_DAYS} days"))
        until = as_of + F.expr("interval 1 hour")
        scored = rollup.seasonal_baseline(under).filter((F.col("hour") >= since) & (F.col("hour") < until)).withColumn("computed_at", as_of)
        t["attention_anomaly"] = replaced(t["attention_anomaly"], scored, rollup.KEY)
        t["region_name"] = replaced(t["region_name"], rollup.region_names(t["event"], as_of), ["region_kind", "region"])
    return t


def hourly_run(tables: dict[str, DataFrame], as_of: Column, full: bool = False) -> dict[str, DataFrame]:
    """A run over the last 48 hours; a full one first counts every hour of the hot window anew, without scores."""
    since = as_of - F.expr(f"interval {HOURS} hours")
    if full:
        start = rollup.full_since(tables["event"], as_of, HOT_DAYS).first()["since"]
        if start is not None:
            tables = rolled_up(tables, as_of, F.lit(start).cast(tables["event"].schema["added_at"].dataType), scores=False)
    return rolled_up(tables, as_of, since)


def pruned(tables: dict[str, DataFrame], folder: str | None, as_of: Column, prune: bool = True) -> tuple[dict[str, DataFrame], dict[str, int], dict[str, str]]:
    """(tables, rows archived, failures): buffers lose their old rows; archived tables only where a folder is given, and only after
    their files are read back. Without prune all stay as they are."""
    if not prune:
        return dict(tables), {}, {}
    kept = {name: archive.retained(rows, *own[:1], as_of, own[1]) if (own := BUFFERS.get(name)) else rows for name, rows in tables.items()}
    return archive.archive_all(kept, folder, as_of)


HOURLY = "region_kind string, region string, hour timestamp, events long, mentions long, sources long"


def published_hours(spark: SparkSession, folder: str, event: DataFrame, mention: DataFrame, as_of: Column, hours: int = HOURS) -> str | None:
    """A run over the published hourly series: of the days that its window touches, and only these, the stored rows are read, the
    window's hours counted anew and the days published as a whole. Returns the run's name."""
    kind = event.schema["added_at"].dataType.simpleString()
    first = F.to_date(as_of - F.expr(f"interval {hours} hours"))
    base = publish.current(spark, folder, HOURLY.replace("timestamp", kind), first)
    out = rollup.incremental(base.drop("day"), event, mention, as_of, hours).withColumn("day", F.to_date("hour"))
    return publish.publish(out.filter(F.col("day") >= first), folder, base.select("day").distinct())


#: The series that a run keeps: their columns (without a time's kind) and the column that says the day.
SERIES = {
    "attention_hourly": (HOURLY, "hour"),
    "attention_daily": ("region_kind string, region string, events long, mentions long, sources long", "day"),
    "mention_hourly": ("event_id {id}, hour timestamp, mentions long, sources long", "hour"),
    "wiki_activity": ("wiki string, title string, hour timestamp, edits long, editors long, created boolean", "hour"),
    "chatter_hourly": ("source string, place_id {id}, hour timestamp, posts long", "hour"),
    "attention_anomaly": ("region_kind string, region string, hour timestamp, events long, mentions long, sources long, baseline_mean double, baseline_sd double, z double, computed_at timestamp", "hour"),
    "region_name": ("region_kind string, region string, name string", None),
}
#: Where a table without a time is kept.
NO_DAY = "1970-01-01"


def with_day(rows: DataFrame, time: str | None) -> DataFrame:
    return rows if time == "day" else rows.withColumn("day", F.to_date(F.lit(NO_DAY)) if time is None else F.to_date(time))


def series_of(spark: SparkSession, folder: str, since: Column | None = None, kind: str = "timestamp", key: str = "string") -> dict[str, DataFrame]:
    """The published series with their column day; `kind` is the kind of their times, `key` that of events and places."""
    read = lambda name, ddl, time: publish.current(spark, folder, ddl.format(id=key).replace("timestamp", kind), since if time else None, name)
    return {name: read(name, *own) for name, own in SERIES.items()}


def publish_series(series: dict[str, DataFrame], folder: str, touched: dict[str, DataFrame] | None = None) -> str | None:
    """All series at once; those of a run name the days it has touched, which it then publishes as a whole."""
    return publish.publish_all({name: (with_day(rows, SERIES[name][1]), (touched or {}).get(name)) for name, rows in series.items()}, folder)


def published_run(spark: SparkSession, folder: str, buffers: dict[str, DataFrame], as_of: Column, hours: int = HOURS) -> str | None:
    """An hourly run over the published series: the stored days under the window's baselines are read, all series counted anew, and
    the days that the window touches published, those of all series at once."""
    kind, key = (buffers["event"].schema[c].dataType.simpleString() for c in ("added_at", "id"))
    first = F.to_date(as_of - F.expr(f"interval {hours} hours"))
    stored = series_of(spark, folder, F.date_sub(first, BASELINE_DAYS), kind, key)
    own = {name: rows if SERIES[name][1] == "day" else rows.drop("day") for name, rows in stored.items()}
    out = rolled_up({**buffers, **own}, as_of, as_of - F.expr(f"interval {hours} hours"))
    recent = lambda rows, time: rows if time is None else rows.filter(F.col("day") >= first)
    new = {name: recent(with_day(out[name].select(*own[name].columns), time), time) for name, (_, time) in SERIES.items()}
    touched = {name: recent(stored[name], time).select("day").distinct() for name, (_, time) in SERIES.items()}
    return publish.publish_all({name: (new[name], touched[name]) for name in SERIES}, folder)
