"""Write semantics as functions of (stored rows, new rows) to the rows to store. Nothing is changed in place:
a job writes the result as a new version of the touched partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_per_key(rows: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """The first row of each key in the order, any if there is none."""
    if not order:
        return rows.dropDuplicates(keys)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def only_new(base: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """What insert-or-skip appends: new rows of unknown keys, the first of each."""
    return one_per_key(new, keys, order).join(base.select(*keys), keys, "left_anti")


def insert_or_skip(base: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    return base.unionByName(only_new(base, new, keys, order).select(*base.columns))


def merge(base: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, str] | None = None, order: list[Column] | None = None) -> DataFrame:
    """Update or insert. For a column, rules says: `keep` the stored value; `fill` from new only what new has;
    `nonblank`, the same where new is ''; `first` and `last` are the least and the greatest; `add` sums.
    Other columns are replaced. Of several new rows of a key the last in the order counts."""
    rules = rules or {}
    order = [c.desc() for c in order] if order else None
    hit = one_per_key(new, keys, order).select(*keys, F.lit(True).alias("_hit"), *(F.col(c).alias(f"_{c}") for c in base.columns if c not in keys))
    both = base.withColumn("_old", F.lit(True)).join(hit, keys, "full_outer")
    out = []
    for c in base.columns:
        old, came = F.col(c), F.col(f"_{c}")
        new_row, no_new = F.col("_old").isNull(), F.col("_hit").isNull()
        value = {
            "keep": lambda: old, "fill": lambda: F.coalesce(came, old), "nonblank": lambda: F.when(came == "", old).otherwise(came),
            "first": lambda: F.least(old, came), "last": lambda: F.greatest(old, came), "add": lambda: old + F.coalesce(came, F.lit(0)),
        }.get(rules.get(c, ""), lambda: came) if c not in keys else None
        out.append(old if value is None else F.when(new_row, came).when(no_new, old).otherwise(value()).alias(c))
    return both.select(*out)


def add_counts(base: DataFrame, delta: DataFrame, keys: list[str], measures: list[str], batch: str | None = None) -> DataFrame:
    """Counts that only grow. With `batch`, both carry the batch a count came from, and a repeated batch adds nothing."""
    if batch:
        delta = delta.join(base.select(batch).distinct(), batch, "left_anti")
        keys = [*keys, batch]
    return base.select(*keys, *measures).unionByName(delta.select(*keys, *measures)).groupBy(*keys).agg(*(F.sum(m).alias(m) for m in measures))


def observed(rows: DataFrame, keys: list[str], seen_at: str, latest: list[str]) -> DataFrame:
    """first_seen, last_seen and the newest value of other columns, of all observations of a key."""
    return rows.groupBy(*keys).agg(F.min(seen_at).alias("first_seen"), F.max(seen_at).alias("last_seen"), *(F.max_by(c, seen_at).alias(c) for c in latest))


def by_origin(rows: DataFrame, keys: list[str], origin: str, ranks: dict[str, int]) -> DataFrame:
    """One row a key, that of the best origin."""
    rank = F.coalesce(*(F.when(F.col(origin) == k, F.lit(v)) for k, v in ranks.items()), F.lit(1 << 30))
    return one_per_key(rows, keys, [rank, F.col(origin)])


def count_attempts(base: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Results of tries replace the stored ones; attempts goes up by one for each key tried."""
    tried = results.join(base.select(*keys, F.col("attempts").alias("_a")), keys, "left").withColumn("attempts", F.coalesce("_a", F.lit(0)) + 1).drop("_a")
    return merge(base, tried.select(*base.columns), keys, {"first_seen": "keep"} if "first_seen" in base.columns else {})


def ledger(entries: DataFrame) -> DataFrame:
    """One row per source and file, the last written."""
    return one_per_key(entries, ["source_id", "file"], [F.desc("fetched_at")])


def children_of_new(base: DataFrame, parents: DataFrame, children: DataFrame, keys: list[str]) -> DataFrame:
    """Child rows of those parents that are new."""
    return children.join(only_new(base, parents, keys).select(*keys), keys, "left_semi")


def seen_and_kept(rows: DataFrame, good: Column, *by: str | Column) -> DataFrame:
    """How many rows came and how many of them are kept."""
    return rows.groupBy(*by).agg(F.count("*").alias("rows_seen"), F.count_if(good).alias("rows_kept"))
