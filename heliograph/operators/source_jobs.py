"""Polled sources as descriptions: how a source's landed answers are read, placed and stored; one runner for all of them.

A run reads what has landed, places rows that come without a point or a country (by the source's own step, then by the shapes of
countries, and only those rows), stores them with the source's rules, links alerts that later ones refer to, and writes
the ledger's row with the numbers that the write itself has counted.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from heliograph.shared import checkpointed, new_folder

from . import facts, geo, upsert

#: A country that a run leaves blank keeps what was found for it before.
RULES = {"country": "nonblank"}
LEDGER = "source string, file string, fetched_at timestamp, rows_seen long, rows_kept long"


@dataclass(frozen=True)
class SourceJob:
    """`read` gives event rows of the landed files, with a column `kept` if some are none, and `refs` if they refer to others."""

    name: str
    read: Callable[[SparkSession, str], DataFrame]
    place: Callable[[DataFrame], DataFrame] | None = None
    rules: dict[str, str] = field(default_factory=lambda: dict(RULES))
    refers: bool = False
    only_new: bool = False


def counted_write(rows: DataFrame, good: Column, path: str) -> dict[str, int]:
    """Writes the good rows, a repeated write in place of the last, and returns rows_seen and rows_kept as counted on the way."""
    seen = Observation()
    counts = (F.count(F.lit(1)).alias("rows_seen"), F.coalesce(F.count_if(good), F.lit(0)).alias("rows_kept"))
    rows.observe(seen, *counts).filter(good).write.mode("overwrite").parquet(path)
    return seen.get


def stored(base: DataFrame, rows: DataFrame, job: SourceJob) -> DataFrame:
    """A source's events after its rows have come."""
    keys, rules = ["external_id"], {**job.rules, **({"superseded_by": "fill"} if job.refers else {})}
    return upsert.insert_or_skip(base, rows, keys) if job.only_new else upsert.merge(base, rows, keys, rules)


def geocoded(rows: DataFrame, shapes: DataFrame, most_km: float = 100.0) -> DataFrame:
    """rows with a country for those that have none and lie in, or near, a shape."""
    placed = rows.withColumn("id", F.col("external_id"))
    return geo.fill_country(placed, shapes, most_km).select(*rows.columns)


def run_source(spark: SparkSession, job: SourceJob, path: str, base: DataFrame, shapes: DataFrame, as_of: Column, most_km: float = 100.0) -> tuple[DataFrame, DataFrame]:
    """(events of the source, its ledger row). base holds the source's stored events, with superseded_by for sources that refer."""
    rows = job.read(spark, path)
    if job.place:
        rows = job.place(rows)
    if "kept" not in rows.columns:
        rows = rows.withColumn("kept", F.lit(True))
    kept = new_folder(spark, f"rows-{job.name}")
    counts = counted_write(rows, F.col("kept"), kept)
    new = spark.read.schema(rows.schema).parquet(kept).drop("kept")
    if job.refers:
        new = new.withColumn("superseded_by", F.lit(None).cast("string"))
    missing = [F.lit("" if c == "country" else None).cast(base.schema[c].dataType).alias(c) for c in base.columns if c not in new.columns]
    # Placing reads the events several times, and the next run reads this one's.
    out = geocoded(checkpointed(stored(base, new.select("*", *missing).select(*base.columns), job)), shapes, most_km)
    if job.refers:  # also to alerts of earlier runs
        later = facts.last_referrer(new).withColumnRenamed("superseded_by", "_by")
        out = out.join(later, "external_id", "left").withColumn("superseded_by", F.coalesce("_by", "superseded_by")).select(*base.columns)
    stamp = F.date_format(as_of, "yyyyMMddHHmm")
    ledger = spark.range(1).select(F.lit(job.name).alias("source"), F.concat(F.lit(f"{job.name}:"), stamp).alias("file"), as_of.cast("timestamp").alias("fetched_at"), *(F.lit(counts[c]).cast("long").alias(c) for c in ("rows_seen", "rows_kept")))
    return out, ledger
