"""Tables published by day: a run writes the days it touched into folders of its own, and a list says which run holds a table's day.

The list gets one small file a run, for all tables of the run together, written last and as a whole by Spark's own commit; before
that no reader sees the run, so one that fails halfway leaves every reader on the old days of all tables, and what it wrote is never
looked at. Days that a run touched and left without rows are listed as empty. One writer at a time; readers need no lock. Runs that no
day points to any more can go once their readers are done (`unused`).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archive

LIST = "version long, run string, name string, day date, filled boolean"
ONE = "rows"


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """All of the list: (version, run, name, day, filled)."""
    if not archive.has_files(spark, f"{folder}/list"):
        return spark.createDataFrame([], LIST)
    return spark.read.schema(LIST).json(f"{folder}/list")


def days_of(spark: SparkSession, folder: str) -> DataFrame:
    """Which run holds each day of each table: the last listed one."""
    return versions(spark, folder).groupBy("name", "day").agg(F.max_by(F.struct("run", "filled"), "version").alias("r")).select("name", "day", "r.run", "r.filled")


def current(spark: SparkSession, folder: str, schema: str, since=None, name: str = ONE) -> DataFrame:
    """A table as last published, with its column day; only the folders of days from `since` on are read, if given."""
    held = days_of(spark, folder).filter(F.col("filled") & (F.col("name") == name))
    if since is not None:
        held = held.filter(F.col("day") >= since)
    base = f"{folder}/data/{name}"
    paths = [f"{base}/run={r['run']}/day={r['day']}" for r in held.collect()]  # one a day
    if not paths:
        return spark.createDataFrame([], f"{schema}, day date")
    return spark.read.schema(f"{schema}, run string, day date").option("basePath", base).parquet(*paths).drop("run")


def publish_all(tables: dict[str, tuple[DataFrame, DataFrame | None]], folder: str) -> str | None:
    """Publishes each table's rows (with a column day) as the whole of their days, and of the days that its second frame names besides,
    all at once. Returns the run's name, None if there is no day at all. A day too large for one task is split over files."""
    run, named = uuid.uuid4().hex, None
    for name, (rows, touched) in tables.items():
        spark, path = rows.sparkSession, f"{folder}/data/{name}/run={run}"
        rows.hint("rebalance", "day").write.partitionBy("day").parquet(path)
        days = spark.read.schema("day date").parquet(path).select("day").distinct().withColumn("filled", F.lit(True))
        if touched is not None:
            days = days.unionByName(touched.select(F.col("day").cast("date").alias("day"), F.lit(False).alias("filled")))
        days = days.withColumn("name", F.lit(name))
        named = days if named is None else named.unionByName(days)
    version = (versions(spark, folder).agg(F.max("version")).first()[0] or 0) + 1
    entries = named.filter("day is not null").groupBy("name", "day").agg(F.bool_or("filled").alias("filled")).select(F.lit(version).alias("version"), F.lit(run).alias("run"), "name", "day", "filled")
    if not entries.limit(1).count():
        return None
    entries.coalesce(1).write.mode("append").json(f"{folder}/list")  # at most a row a table and day
    return run


def publish(rows: DataFrame, folder: str, touched: DataFrame | None = None) -> str | None:
    """`publish_all` of one table."""
    return publish_all({ONE: (rows, touched)}, folder)


def unused(spark: SparkSession, folder: str) -> DataFrame:
    """Runs in the list that hold no day any more."""
    return versions(spark, folder).select("run").distinct().join(days_of(spark, folder).select("run"), "run", "left_anti")
