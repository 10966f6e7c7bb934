"""Writers for foreachBatch: file series with their ledger, posts whose names are read anew, live pointers, edits with frozen hours.

A micro-batch that is run again replaces what it wrote; what a half-run batch left is not read, since readers take only batches
whose last file is there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from heliograph.operators import archive, gazetteer, publish, rollup
from heliograph.sources import files, snapshots

from . import five_minute_counts, place_hits, run_once

# File series.

#: What a file is, by the end of its name, in the order in which a batch's files are loaded: mentions need their events.
SERIES = {"events": ".export", "mentions": ".mentions", "articles": ".gkg"}


def numbered(spark: SparkSession, folder: str, kind: str) -> DataFrame | None:
    """All rows of a kind with their batch, None before the first batch that has any."""
    if not archive.has_files(spark, f"{folder}/{kind}"):
        return None
    return spark.read.option("basePath", f"{folder}/{kind}").option("mergeSchema", "true").parquet(f"{folder}/{kind}/batch=*")


def loaded(spark: SparkSession, folder: str, kind: str) -> DataFrame | None:
    """Rows of a kind of the batches that have a ledger, so no half of a batch."""
    rows, done = numbered(spark, folder, kind), numbered(spark, folder, "ledger")
    if rows is None or done is None:
        return None
    return rows.join(F.broadcast(done.select("batch").distinct()), "batch", "left_semi")


def file_batches(folder: str, fail: Callable[[int, str], None] | None = None):
    """For foreachBatch over (value, file): the lines of a batch's files, all files of a kind at once, events first, and one ledger row a
    file, written last. What a file kept is counted in what the write has left, in which each row names its file. `fail` is called before
    each step with the batch and what comes next."""

    def parsed(spark: SparkSession, kind: str, lines: DataFrame, batch_id: int) -> DataFrame:
        if kind == "events":
            return files.event_rows(lines, ["file"]).filter("kept")
        if kind == "articles":
            return files.articles(lines, ["file"])
        rows = files.mention_rows(lines, ["file"]).filter("kept")
        known = [x for x in (loaded(spark, folder, "events"),) if x is not None]
        here = f"{folder}/events/batch={batch_id}"
        known += [spark.read.option("recursiveFileLookup", "true").parquet(here)] if archive.has_files(spark, here) else []
        ids = None
        for k in known:
            k = k.select(F.col("external_id").alias("event_id"))
            ids = k if ids is None else ids.unionByName(k)
        return rows.limit(0) if ids is None else rows.join(ids, "event_id", "left_semi")

    def write(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        kind = F.coalesce(*(F.when(F.col("file").endswith(end), k) for k, end in SERIES.items()))
        rows = rows.withColumn("kind", kind).filter("kind is not null").persist()
        ledger = rows.groupBy("kind", "file").agg(F.count("*").alias("rows_seen"))
        come = {r["kind"] for r in rows.select("kind").distinct().collect()}
        left = None
        for kind in SERIES:
            if kind not in come:
                continue
            if fail:
                fail(batch_id, kind)
            own, path = parsed(spark, kind, rows.filter(F.col("kind") == kind).select("value", "file"), batch_id), f"{folder}/{kind}/batch={batch_id}"
            own.write.mode("overwrite").parquet(path)
            counts = spark.read.schema("file string").parquet(path).groupBy("file").agg(F.count("*").alias("rows_kept"))
            left = counts if left is None else left.unionByName(counts)
        if fail:
            fail(batch_id, "ledger")
        whole = ledger.join(left, "file", "left") if left is not None else ledger.withColumn("rows_kept", F.lit(0).cast("long"))
        whole.select("kind", "file", "rows_seen", F.coalesce("rows_kept", F.lit(0)).alias("rows_kept")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/ledger/batch={batch_id}")  # a row a file
        rows.unpersist()

    return write


def load_files(spark: SparkSession, landing: str, folder: str, checkpoint: str, per_trigger: int = 3, fail: Callable[[int, str], None] | None = None) -> StreamingQuery:
    """All file series of a landing folder, `per_trigger` files a micro-batch, in the order of their times."""
    lines = spark.readStream.option("maxFilesPerTrigger", per_trigger).text(landing).select("value", F.col("_metadata.file_name").alias("file"))
    return run_once(lines, "", checkpoint, file_batches(folder, fail))


# Posts.


def names_from(spark: SparkSession, path: str, stops: str | None = None) -> Callable[[], DataFrame]:
    """A function that reads the names (name, place_id) of a folder as they are now, without the stop names of another."""

    def read() -> DataFrame:
        names = spark.read.parquet(path)
        return names.join(spark.read.parquet(stops).select("name"), "name", "left_anti") if stops and archive.has_files(spark, stops) else names

    return read


POINTERS = "at timestamp, uri string, place_id long, hour timestamp, n long"


def live_posts(names: Callable[[], DataFrame], folder: str, most: int = 20, keep: str = "48 hours", late: str = "1 hour", fail: Callable[[int, str], None] | None = None):
    """For foreachBatch over messages: counts of five minutes, and the pointers that are live after the batch, published as a table
    of its own. A place's hour gets its first `most` posts, in the order of batches and within one of time and uri; a
    delete takes its post's pointers away and frees no place; pointers go `keep` after the newest post. A batch that is run
    again starts from the pointers before it."""

    def write(messages: DataFrame, batch_id: int) -> None:
        spark = messages.sparkSession
        posts = snapshots.post_rows(messages).select("op", "at", "uri").persist()  # without texts
        hits = place_hits(messages, names()).persist()
        five_minute_counts(hits).write.mode("overwrite").parquet(f"{folder}/counts/batch={batch_id}")
        if fail:
            fail(batch_id, "pointers")
        before = pointers_of(spark, folder, batch_id - 1)
        taken = before.groupBy("place_id", "hour").agg(F.max("n").alias("had"))
        new = hits.withColumn("hour", F.date_trunc("hour", "at")).join(before.select("uri", "place_id"), ["uri", "place_id"], "left_anti")
        first = gazetteer.first_pointers(new.select("at", "uri", "place_id"), most).join(taken, ["place_id", "hour"], "left")
        order = F.row_number().over(Window.partitionBy("place_id", "hour").orderBy("at", "uri"))
        placed = first.withColumn("n", (F.coalesce("had", F.lit(0)) + order).cast("long")).filter(F.col("n") <= most).select("at", "uri", "place_id", "hour", "n")
        gone = posts.filter("op = 'delete'").select("uri").distinct().withColumn("_gone", F.lit(True))
        # A deleted pointer keeps its number, without its post, so that nothing takes its place.
        every = before.unionByName(placed).join(gone, "uri", "left").withColumn("uri", F.when(F.col("_gone").isNull(), F.col("uri"))).drop("_gone")
        newest = before.select("at").unionByName(posts.select("at")).agg(F.max("at").alias("t")).first()["t"]
        kept = every.filter(F.col("at") > F.lit(newest) - F.expr(f"interval {keep}")) if newest else every
        kept.write.mode("overwrite").parquet(f"{folder}/live/batch={batch_id}")
        posts.unpersist()
        hits.unpersist()

    return write


def pointers_of(spark: SparkSession, folder: str, batch_id: int) -> DataFrame:
    path = f"{folder}/live/batch={batch_id}"
    return spark.read.schema(POINTERS).parquet(path) if archive.has_files(spark, path) else spark.createDataFrame([], POINTERS)


def live_now(spark: SparkSession, folder: str) -> DataFrame:
    """The stream's own table of live pointers after its last whole batch: (at, uri, place_id, hour)."""
    done = [int(p.split("=")[1]) for p in archive.folders(spark, f"{folder}/live") if p.startswith("batch=") and archive.has_files(spark, f"{folder}/live/{p}/_SUCCESS")]
    return pointers_of(spark, folder, max(done, default=-1)).filter("uri is not null").drop("n")


# Edits.

EDIT_HOURS = "wiki string, title string, hour timestamp, edits long, editors long, created boolean"


def edit_batches(folder: str, keep: str = "72 hours"):
    """For foreachBatch over edit messages: the buffer of the last `keep`, and the hours of pages, counted anew where the buffer
    holds an hour whole and published by day. An hour that the buffer has lost in part is frozen: a late row changes
    nothing there."""

    def write(messages: DataFrame, batch_id: int) -> None:
        spark = messages.sparkSession
        rows = snapshots.edit_rows(messages).dropDuplicates(["wiki", "rev"])
        before, whole = f"batch={batch_id - 1}", rows
        last = spark.read.parquet(f"{folder}/floor/{before}").first()["floor"] if archive.has_files(spark, f"{folder}/floor/{before}") else None
        if last is not None:  # None before the first edit of all
            held, floor = spark.read.parquet(f"{folder}/buffer/{before}"), F.lit(last)
            new = rows.filter(F.date_trunc("hour", "at") >= floor).join(held.select("wiki", "rev"), ["wiki", "rev"], "left_anti")
            rows = held.unionByName(new.select(*held.columns))
            whole = rows.filter(F.col("at") >= floor)
        rows, whole = rows.persist(), whole.persist()
        fresh = rollup.page_activity(whole).withColumn("day", F.to_date("hour")).persist()  # a row a page and hour
        since = fresh.agg(F.min("hour").alias("h")).first()["h"]
        if since is not None:
            old = publish.current(spark, f"{folder}/hours", EDIT_HOURS, F.to_date(F.lit(since)))
            days = fresh.select("day").distinct()
            kept = old.join(days, "day", "left_semi").join(fresh.select("wiki", "title", "hour"), ["wiki", "title", "hour"], "left_anti")
            publish.publish(kept.unionByName(fresh.select(*kept.columns)), f"{folder}/hours", days)
        newest = rows.agg((F.max("at") - F.expr(f"interval {keep}")).alias("t")).select("t", rollup.first_whole_hour(F.col("t")).alias("floor"))
        kept = rows.filter(F.col("at") >= F.lit(newest.first()["t"]))
        kept.write.mode("overwrite").parquet(f"{folder}/buffer/batch={batch_id}")
        newest.select("floor").coalesce(1).write.mode("overwrite").parquet(f"{folder}/floor/batch={batch_id}")
        for frame in (rows, whole, fresh):
            frame.unpersist()

    return write


def edit_hours(spark: SparkSession, folder: str) -> DataFrame:
    """The hours of pages as the stream has published them."""
    return publish.current(spark, f"{folder}/hours", EDIT_HOURS).drop("day")
