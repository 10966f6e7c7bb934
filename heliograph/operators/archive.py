"""The cold tier: one Parquet folder a table and day, only ever appended to, and only whole days that are due."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """How long a table stays hot, names of sources whose rows never leave, and its parent for tables without a time."""

    table: str
    time: str
    days: int
    keep_sources: tuple[str, ...] = ()
    parent: str | None = None
    key: str | None = None


#: Days in the hot tier, by table. Two feeds go on serving items long after their start, so those stay.
POLICIES = (
    Policy("event", "added_at", 60, keep_sources=("gdacs-alerts", "usgs-volcanoes")), Policy("theme_hourly", "hour", 7), Policy("mention_hourly", "hour", 7), Policy("attention_hourly", "hour", 35),
    Policy("wiki_activity", "hour", 30), Policy("chatter_hourly", "hour", 30), Policy("gkg_article", "added_at", 30), Policy("gkg_location", "added_at", 30, parent="gkg_article", key="article_id"),
    Policy("firms_detection", "acq_at", 30), Policy("theme_daily", "day", 7),
)


def bound(as_of: Column, days: int) -> Column:
    """Rows before this UTC midnight are due."""
    return F.date_trunc("day", as_of) - F.expr(f"interval {days} days")


def due(rows: DataFrame, time: str, as_of: Column, days: int, keep: DataFrame | None = None) -> DataFrame:
    """Rows that leave; keep has the source_id of sources whose rows stay."""
    out = rows.filter(F.col(time) < bound(as_of, days))
    return out if keep is None else out.join(keep, "source_id", "left_anti")


def due_days(rows: DataFrame, time: str, as_of: Column, days: int) -> DataFrame:
    return due(rows, time, as_of, days).select(F.to_date(time).alias("day")).distinct()


def archive_columns(rows: DataFrame) -> DataFrame:
    """What goes to files: intervals and maps as text, floats widened; nested and simple columns as they are."""
    cast = {"float": "double", "void": "string"}
    return rows.select(*(F.to_json(c).alias(c) if k.startswith("map") else F.col(c).cast(cast.get(k, "string" if k.startswith("interval") else k)).alias(c) for c, k in rows.dtypes))


class ShortArchive(Exception):
    """Fewer rows can be read back than were written."""


def data_files(spark: SparkSession, path: str) -> set[str]:
    """The Parquet files of a folder; none if it is not there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {str(x.getPath()) for x in fs.listStatus(p) if x.getPath().getName().endswith(".parquet")} if fs.exists(p) else set()


def drop_files(spark: SparkSession, files: list[str]) -> None:
    for f in files:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, False)


def archive_slice(hot: DataFrame, folder: str, policy: Policy, as_of: Column, parents: DataFrame | None = None, keep: DataFrame | None = None, count: Callable[[DataFrame], int] = DataFrame.count) -> tuple[DataFrame, int]:
    """Appends what is due below folder, a day a partition, reads the files of this pass back, and only if all rows are
    there returns (what stays hot, rows archived); else they are deleted. Late rows of an archived day become a new file. Only
    the folders of due days are listed, and only new files read."""
    if policy.parent:
        rows = hot.join(due(parents, policy.time, as_of, policy.days).select(policy.key, F.to_date(policy.time).alias("day")), policy.key)
    else:
        rows = due(hot, policy.time, as_of, policy.days, keep).withColumn("day", F.to_date(policy.time))
    by_day = {r["day"]: r["n"] for r in rows.groupBy("day").agg(F.count("*").alias("n")).collect()}
    n = sum(by_day.values())
    if not n:
        return hot, 0
    spark, path = hot.sparkSession, f"{folder}/{policy.table}"
    listed = lambda: set().union(*(data_files(spark, f"{path}/day={d}") for d in by_day))
    before = listed()
    # Days together, so that a day has few files; a day too large for one task is split.
    archive_columns(rows).hint("rebalance", "day").write.partitionBy("day").mode("append").option("compression", "zstd").parquet(path)
    new = sorted(listed() - before)
    if not new or count(spark.read.parquet(*new)) != n:
        drop_files(spark, new)
        raise ShortArchive(f"{policy.table}: {n} rows were due")
    if policy.parent:
        return hot.join(rows.select(policy.key).distinct(), policy.key, "left_anti"), n
    stays = hot.filter(F.coalesce(F.col(policy.time) >= bound(as_of, policy.days), F.lit(True)))
    return (stays if keep is None else stays.unionByName(hot.filter(F.col(policy.time) < bound(as_of, policy.days)).join(keep, "source_id", "left_semi").select(*hot.columns))), n


def has_files(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if it is not there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def stored(spark: SparkSession, path: str) -> DataFrame:
    """An archived table; files of different ages are united by column name."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def archive_all(tables: dict[str, DataFrame], folder: str | None, as_of: Column, policies: tuple[Policy, ...] = POLICIES) -> tuple[dict[str, DataFrame], dict[str, int], dict[str, str]]:
    """(hot tables after, rows archived, failures by table). Children go before their parents, one failing
    table stops no other, and without a folder nothing leaves. tables has `source` for policies that keep some sources' rows."""
    hot, done, failed = dict(tables), {}, {}
    for p in sorted(policies, key=lambda p: p.parent is None) if folder else []:
        if p.table in tables:
            try:
                keep = tables["source"].filter(F.col("name").isin(*p.keep_sources)).select(F.col("id").alias("source_id")) if p.keep_sources else None
                hot[p.table], done[p.table] = archive_slice(tables[p.table], folder, p, as_of, tables.get(p.parent) if p.parent else None, keep)
            except Exception as e:  # the next table is tried in any case
                failed[p.table] = str(e)
    return hot, done, failed


def retained(rows: DataFrame, time: str, as_of: Column, keep: str) -> DataFrame:
    """What a raw buffer still holds."""
    return rows.filter(F.col(time) >= as_of - F.expr(f"interval {keep}"))


def views(spark: SparkSession, folder: str, names: list[str]) -> list[str]:
    """A view for each archived table that has files; the names of those made."""
    made = [n for n in names if has_files(spark, f"{folder}/{n}")]
    for n in made:
        stored(spark, f"{folder}/{n}").createOrReplaceTempView(n)
    return made


def archive_query(spark: SparkSession, sql: str, folder: str, names: list[str]) -> DataFrame:
    views(spark, folder, names)
    return spark.sql(sql)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows as often: each row's count in one less that in the other is 0."""
    sides = a.withColumn("_d", F.lit(1)).unionByName(b.select(*a.columns).withColumn("_d", F.lit(-1)))
    return sides.groupBy(*a.columns).agg(F.sum("_d").alias("_d")).filter("_d <> 0").limit(1).count() == 0
