"""Streams: edits, posts and file series, each with the same result as its batch twin once all has come.

File sources go by modification time, so land files in time order; backfill as a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from heliograph.operators import gazetteer
from heliograph.sources import files, snapshots

LATE = "72 hours"


def lines(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """New lines of a landing folder; the checkpoint remembers which files were read."""
    return spark.readStream.option("maxFilesPerTrigger", per_trigger).text(path)


def edits(messages: DataFrame, late: str = LATE) -> DataFrame:
    """Edits, each revision once."""
    return snapshots.edit_rows(messages).withWatermark("at", late).dropDuplicatesWithinWatermark(["wiki", "rev"])


#: Groups of users that an hour of a page is dealt into, so that no row of state grows with all editors of a page.
USER_GROUPS = 256


def hourly_editors(rows: DataFrame, late: str = LATE) -> DataFrame:
    """Distinct human editors per page and hour, given out when the hour can get no more rows; edits without a user count for none.
    State is a row a page, hour and group of users within the lateness: the set of its users, who share the key that a row
    a user would repeat. The groups' sizes are added up as they are given out."""
    human = rows.filter(~F.col("bot")).withWatermark("at", late).withColumn("w", F.window("at", "1 hour"))
    group = F.pmod(F.xxhash64("user_hash"), F.lit(USER_GROUPS)).alias("users")
    sets = human.groupBy("wiki", "title", "w", group).agg(F.size(F.collect_set("user_hash")).alias("n"))
    return sets.groupBy("wiki", "title", "w").agg(F.sum("n").alias("editors")).select("wiki", "title", F.col("w.start").alias("hour"), "editors")


def place_hits(messages: DataFrame, names: DataFrame) -> DataFrame:
    """Posts that name a place: (at, uri, place_id), a place once a post; of a batch, or of a micro-batch (see `post_batches`). A post's
    time goes along with its matches, so that messages are read once."""
    posts = snapshots.post_rows(messages).filter("op = 'create' and text is not null").dropDuplicates(["uri"])
    hits = gazetteer.match_names(posts.select(F.struct("at", "uri").alias("id"), "text"), names)
    return hits.select("id.at", "id.uri", "place_id").distinct()


def five_minute_counts(hits: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Posts per place and five minutes; of a stream, updated as they come."""
    return hits.withWatermark("at", late).groupBy(F.window("at", "5 minutes").alias("w"), "place_id").agg(F.count("*").alias("posts")).select(F.col("w.start").alias("bucket"), "place_id", "posts")


def theme_counts(articles: DataFrame, late: str = LATE) -> DataFrame:
    """Articles per country, theme and day as a stream; an article is taken once."""
    once = articles.withWatermark("added_at", late).dropDuplicatesWithinWatermark(["gkg_id"])
    countries = F.array_distinct(F.transform("places", lambda p: p["country"]))
    flat = once.select("added_at", F.explode(countries).alias("region"), "themes").select("added_at", "region", F.explode("themes").alias("theme"))
    return flat.groupBy(F.window("added_at", "1 day").alias("w"), "region", "theme").agg(F.count("*").alias("articles")).select(F.col("w.start").alias("day"), "region", "theme", "articles")


def run_once(df: DataFrame, out: str, checkpoint: str, batch=None, mode: str = "append") -> StreamingQuery:
    """All that has landed, then stop. Parquet below out, or batch(rows, batch_id) for each micro-batch."""
    w = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode)
    q = (w.foreachBatch(batch) if batch else w.format("parquet").option("path", out)).start()
    q.awaitTermination()
    return q


def replacing(folder: str, keys: list[str]):
    """For foreachBatch in update mode: each batch is a version of its own folder, so a repeated batch replaces
    itself; readers take the latest value of each key (see `current`)."""

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return write


def current(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/batch=*")
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select(*keys, "r.*")


def post_batches(names: DataFrame, folder: str):
    """For foreachBatch over messages: each micro-batch's place counts of five minutes, its pointers and its deleted posts, each
    in a folder of the batch's own, so that a repeated batch replaces itself. For names that change while the stream runs, and for
    pointers that the stream itself takes back, see `batches.live_posts`."""

    def write(messages: DataFrame, batch_id: int) -> None:
        hits = place_hits(messages, names).persist()
        put = lambda rows, kind: rows.write.mode("overwrite").parquet(f"{folder}/{kind}/batch={batch_id}")
        put(five_minute_counts(hits), "counts")
        put(hits, "pointers")
        put(snapshots.post_rows(messages).filter("op = 'delete'").select("uri", "at"), "deleted")
        hits.unpersist()

    return write


def added_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Posts per place and five minutes over all batches; deleted posts still count."""
    return spark.read.parquet(f"{folder}/counts").groupBy("bucket", "place_id").agg(F.sum("posts").alias("posts"))


def live_pointers(spark: SparkSession, folder: str, most: int = 20) -> DataFrame:
    """The first posts of each place and hour over all batches, without those deleted since."""
    return pointers(spark.read.parquet(f"{folder}/pointers").select("at", "uri", "place_id"), spark.read.parquet(f"{folder}/deleted"), most)


def pointers(hits: DataFrame, deleted: DataFrame, most: int = 20) -> DataFrame:
    """The first posts of each place and hour without the deleted ones; counts are never taken back."""
    return gazetteer.first_pointers(hits, most).join(deleted.select("uri"), "uri", "left_anti")


#: Groups of places that an hour's state is dealt into. A group of its own for each place and hour would call Python once for a row or two.
PLACE_GROUPS = 8


def keep_first(most: int = 20, hours: int = 48):
    """State for a stream's pointers, by (hour, group of places): how many of each place were given out, for `hours` hours. Of what comes
    no more than the first `most` of each place is held at a time."""

    def run(key, batches, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        given = dict(zip(*state.get, strict=True)) if state.exists else {}
        first = None
        for rows in batches:
            both = rows if first is None else pd.concat([first, rows])
            first = both.sort_values(["at", "uri"]).groupby("place_id", sort=False, dropna=False).head(most)
        place = [None if pd.isna(p) else int(p) for p in first["place_id"]]
        order = first.groupby("place_id", sort=False, dropna=False).cumcount().tolist()
        good = [k + given.get(p, 0) < most for k, p in zip(order, place, strict=True)]
        for p, x in zip(place, good, strict=True):
            given[p] = given.get(p, 0) + x
        state.update((list(given), list(given.values())))
        ends = int(pd.Timestamp(key[0]).timestamp() * 1000) + (hours + 1) * 3_600_000
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield first.loc[good, ["place_id", "hour", "at", "uri"]]

    return run


def first_pointers(hits: DataFrame, most: int = 20, hours: int = 48, late: str = "1 hour") -> DataFrame:
    """The first `most` posts of each place and hour as they arrive; state goes by event time."""
    placed = hits.withWatermark("at", late).withColumn("hour", F.date_trunc("hour", "at"))
    group = F.when(F.col("place_id").isNotNull(), F.pmod(F.xxhash64("place_id"), F.lit(PLACE_GROUPS)))
    return placed.withColumn("places", group).groupBy("hour", "places").applyInPandasWithState(keep_first(most, hours), "place_id long, hour timestamp, at timestamp, uri string", "places array<long>, given array<long>", "append", "EventTimeTimeout")


def load_series(spark: SparkSession, landing: str, out: str, checkpoint: str, parse=files.events, per_trigger: int = 1) -> StreamingQuery:
    """A file series, a micro-batch a file: parsed rows below out, a batch's rows in its own folder."""

    def write(rows: DataFrame, batch_id: int) -> None:
        parse(rows).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return run_once(lines(spark, landing, per_trigger), out, checkpoint, write)
