"""Helpers that the operators of this subpackage share: places to write to and cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: space and the controls from tab to carriage return.
SPACE = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session. Only a session on one machine may lack that setting and
    gets a temporary folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path for one run's files in the shared folder; the writer creates it."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder, so that neither a lost executor nor a second use runs its plan again."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower case for A-Z only."""
    return F.translate(c, UPPER, LOWER)


def uniform(c: Column, salt: str) -> Column:
    """A number in (0, 1), the same on every run and in any engine with md5: its first 52 bits."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}:"), c)), 1, 13), 16, 10).cast("long")
    return (bits + 0.5) / F.lit(float(2**52))


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_commonest_apart(rows: DataFrame, values: DataFrame, key: str, times: str, most: int = 50_000) -> DataFrame:
    """rows with the columns of values, one row a key, null where there is none; `times` says how many rows have a key and is left
    out. The values of the `most` commonest keys go to every task, so that no key with very many rows is dealt to one task; what
    is left has few rows a key (a most-th part of all at most) and is joined by the key."""
    common = cut(values.orderBy(F.desc(times), key).limit(most).drop(times))
    first = rows.join(F.broadcast(common.withColumn("_here", F.lit(True))), key, "left")
    if values.limit(most + 1).count() <= most:
        return first.drop("_here")
    others = values.drop(times).join(F.broadcast(common.select(key)), key, "left_anti")
    rest = first.filter("_here is null").drop("_here", *(c for c in common.columns if c != key)).join(others, key, "left")
    return first.filter("_here").drop("_here").unionByName(rest)
