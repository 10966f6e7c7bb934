"""Outlets: hosts and links matched to a registry, names resolved, and reports of what it lacks."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.functions import good_handle, host_suffixes, link_host, links_in, name_keys, name_variants
from heliograph.operators.upsert import one_per_key
from heliograph.shared import checkpointed


def match_hosts(rows: DataFrame, host: str | Column, ids: DataFrame, outlets: DataFrame) -> DataFrame:
    """rows with the outlets that registered their host or a parent domain of it, one row a registration. The
    suffixes turn `ends with` into an equality, so the join hashes; the registry is a dimension."""
    h = F.col(host) if isinstance(host, str) else host
    named = ids.filter("kind = 'host'").select(F.col("value").alias("suffix"), F.col("country").alias("outlet_country"), F.col("name").alias("outlet"))
    known = outlets.select(F.col("country").alias("outlet_country"), F.col("name").alias("outlet"), "typology")
    return rows.withColumn("suffix", F.explode(host_suffixes(h))).join(named, "suffix").join(known, ["outlet_country", "outlet"])


def linked_outlets(rows: DataFrame, ids: DataFrame, outlets: DataFrame) -> DataFrame:
    """rows with a link (column url), and the outlets whose site it points at."""
    return match_hosts(rows.withColumn("_host", link_host(F.col("url"))).filter("_host is not null"), "_host", ids, outlets).drop("_host")


def post_links(posts: DataFrame, channels: DataFrame, ids: DataFrame, outlets: DataFrame) -> DataFrame:
    """Links of the posts of known channels to registered outlets."""
    linked = posts.join(channels.select("handle"), "handle", "left_semi").select("handle", "post_id", "posted_at", F.explode("links").alias("url"))
    return linked_outlets(linked, ids, outlets)


def description_links(videos: DataFrame, channels: DataFrame, ids: DataFrame, outlets: DataFrame) -> DataFrame:
    """Links in the descriptions of known channels' videos to registered outlets."""
    linked = videos.join(channels.select("channel_id"), "channel_id", "left_semi").select("video_id", "channel_id", F.explode(links_in(F.col("description"))).alias("url"))
    return linked_outlets(linked, ids, outlets)


def resolve_entities(outlets: DataFrame, candidates: DataFrame) -> DataFrame:
    """Outlets with the one entity of their country that any of their names fits; where several do, only those
    that fit by the full name count; still several, or none, resolve nothing."""
    names = outlets.select("country", "name", F.posexplode(name_variants(F.col("name"))).alias("place", "variant"))
    found = names.join(candidates.select("country", F.lower("label").alias("label"), "qid"), (names["country"] == candidates["country"]) & (F.lower(names["variant"]) == F.col("label"))).select(names["country"], "name", "qid", "place")
    hits = found.groupBy("country", "name").agg(F.collect_set("qid").alias("every"), F.collect_set(F.when(F.col("place") == 0, F.col("qid"))).alias("full"))
    one = F.when(F.size("every") == 1, F.col("every")[0]).when(F.size("full") == 1, F.col("full")[0])
    return hits.select("country", "name", one.alias("qid")).filter("qid is not null")


def first_listed(outlets: DataFrame, aliases: DataFrame) -> DataFrame:
    """Outlets of several lists, each once: in order of priority and name, a row goes if a kept one of its country shares a
    name key. What was dropped blocks nothing, so order matters: in rounds, rows that come first for all their keys stay, those
    that share a key with them go, and the rest goes on, as many rounds as the longest chain of such rows."""
    order = ["priority", "name"]
    rows = one_per_key(outlets, ["country", *order])
    renamed = rows.join(aliases.select("country", F.col("alias").alias("name"), F.col("name").alias("main")), ["country", "name"], "left")
    # A row without any key has one that no other has.
    alone = F.concat(F.lit(" "), F.col("priority").cast("string"), F.lit(" "), "name")
    keyed = renamed.withColumn("key", F.explode_outer(name_keys(F.coalesce("main", "name")))).select("country", *order, F.coalesce("key", alone).alias("key"))
    left, kept = checkpointed(keyed), []
    while left.limit(1).count():
        first = left.groupBy("country", "key").agg(F.min(F.struct(*order)).alias("first"))
        judged = left.join(first, ["country", "key"]).withColumn("leads", F.struct(*order) == F.col("first"))
        now = checkpointed(judged.groupBy("country", *order).agg(F.bool_and("leads").alias("leads")).filter("leads").select("country", *order))
        kept.append(now)
        taken = left.join(now, ["country", *order], "left_semi").select("country", "key").distinct()
        gone = left.join(taken, ["country", "key"], "left_semi").select("country", *order).unionByName(now).distinct()
        left = checkpointed(left.join(gone, ["country", *order], "left_anti"))
    every = functools.reduce(DataFrame.unionByName, kept) if kept else keyed.select("country", *order)
    return rows.join(every, ["country", *order], "left_semi").select(*outlets.columns)


def assert_known(manual: DataFrame, outlets: DataFrame) -> DataFrame:
    """manual, if each of its outlets is registered; else an error that names some."""
    unknown = manual.join(outlets.select("country", "name"), ["country", "name"], "left_anti").select("country", "name").distinct().limit(5).collect()
    if unknown:
        raise ValueError(f"unknown outlets: {[tuple(r) for r in unknown]}")
    return manual


def without_host(outlets: DataFrame, ids: DataFrame) -> DataFrame:
    return outlets.join(ids.filter("kind = 'host'").select("country", "name"), ["country", "name"], "left_anti")


def silent_hosts(ids: DataFrame, articles: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Registered hosts of which no article came lately."""
    seen = articles.filter(F.col("added_at") > as_of - F.expr(f"interval {days} days")).select(F.explode(host_suffixes(F.col("site"))).alias("value")).distinct()
    return ids.filter("kind = 'host'").join(seen, "value", "left_anti")


def channel_gaps(ids: DataFrame, channels: DataFrame, posts: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Registered channels that can be collected and yield nothing: without a preview, or without a post lately."""
    asked = ids.filter("kind = 'telegram'").filter(good_handle(F.col("value"))).select("country", "name", F.col("value").alias("handle"))
    lately = posts.filter(F.col("posted_at") > as_of - F.expr(f"interval {days} days")).select("handle", F.lit(True).alias("posted")).distinct()
    state = F.when(~F.col("preview"), "no preview").when(F.col("posted").isNull(), f"no post in {days} days")
    return asked.join(channels.select("handle", "preview"), "handle", "left").join(lately, "handle", "left").select("country", "name", "handle", state.alias("gap")).filter("gap is not null")


def video_gaps(channels: DataFrame, videos: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Video channels that are gone, with the reason, or without an upload lately."""
    lately = videos.filter(F.col("published_at") > as_of - F.expr(f"interval {days} days")).select("channel_id", F.lit(True).alias("uploaded")).distinct()
    state = F.when(F.col("status") == "gone", F.concat(F.lit("gone: "), F.substring("reason", 1, 60))).when(F.col("uploaded").isNull(), f"no upload in {days} days")
    return channels.join(lately, "channel_id", "left").select("country", "name", "channel_id", state.alias("gap")).filter("gap is not null")
