"""Mixing sources to target weights.

Every source gets a share of all words; a share above `max_epochs` times the source's own size is cut
there and the excess goes to the others by weight. A share of e + f epochs is e whole passes over the
source and then a weighted sample without replacement (Efraimidis-Spirakis): each document draws an
exponential key with its quality as rate, and the documents with the least keys are taken until their
prefix sum reaches the rest of the budget.

The order within a source is never made by one task. Keys are put into about sqrt(n) buckets a source by
their distribution function; sums of buckets give each bucket's start, and rows are sorted only within
their bucket. So a source with a third of all rows costs no task more than the others.

Nulls: a null text has size 0, a null source is a source of its own and comes last, a null or repeated
doc_id is allowed. Documents of size 0 are taken in no words. Very long texts count whole. Documents of equal keys, like repeated rows, are
taken together or not at all. An empty table gives an empty result. More
columns of the input are left out of `mix_plan` and kept by `mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import SPACE, cut, table, uniform

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SALT = "mix-1"


def word_count(text: Column) -> Column:
    """Number of words; a null or blank text has none."""
    parts = F.split(text, SPACE, -1)
    edge = (F.element_at(parts, 1) == "").cast("int") + (F.element_at(parts, -1) == "").cast("int")
    blank = text.isNull() | text.rlike("^[\\x20\\x09-\\x0D]*$")
    return F.when(blank, 0).otherwise(F.size(parts) - edge).cast("long")


def quality(text: Column) -> Column:
    """Rate of a document's key, 0.25 to 1: grows with the part of the text that is not ASCII signs or digits."""
    n = F.length(text)
    kept = F.length(F.regexp_replace(text, "[\\x21-\\x40\\x5b-\\x60\\x7b-\\x7e]+", ""))
    return F.when(n > 0, 0.25 + 0.75 * (kept / n)).otherwise(F.lit(0.25))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source_size and target for each source; sizes has a row (source, source_size, n) per source.

    Only one row per source is ordered here. Sources are met in the order in which a rising level of words
    per weight reaches their caps; the level that holds for all is where the uncapped ones use up the rest.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ratio = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    below = ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return (
        sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1))
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("full_at", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("level_here", (F.col("total") - F.coalesce(F.sum("cap").over(below), F.lit(0))) / F.sum("weight").over(rest))
        .withColumn("full", F.col("full_at") <= F.col("level_here"))
        .withColumn("open_weight", F.sum(F.when(~F.col("full"), F.col("weight"))).over(Window.partitionBy()))
        .withColumn("full_words", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(Window.partitionBy()), F.lit(0)))
        .withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * ((F.col("total") - F.col("full_words")) / F.col("open_weight"))))
        .select("source", "source_size", "n", "target")
    )


def document_keys(docs: DataFrame, salt: str = SALT) -> DataFrame:
    """docs with size, quality and the exponential key of each row; equal rows get equal keys."""
    who = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    return (
        docs.withColumn("mix_size", word_count(F.col("text")))
        .withColumn("mix_quality", quality(F.col("text")))
        .withColumn("mix_key", -F.log(uniform(who, salt)) / F.col("mix_quality"))
    )


def bucket() -> Column:
    """A row's bucket of about sqrt(n) in its source: the distribution function of its key at the source's mean rate."""
    return F.least(F.col("buckets") - 1, F.floor(F.col("buckets") * (1 - F.exp(-F.col("mix_key") * F.col("rate")))))


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """df to be joined without a shuffle, if it has few rows (it is counted), else as it is."""
    return F.broadcast(df) if df.count() <= most else df


def source_cuts(keyed: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """For each source: source_size, target, epochs, and what the weighted sample takes: all rows of the
    buckets before cut_bucket, and of that bucket those with a key up to cut_key."""
    by_source = keyed.groupBy("source").agg(F.sum("mix_size").alias("source_size"), F.count("*").alias("n"), F.avg("mix_quality").alias("rate"))
    by_source = cut(by_source)
    targets = source_targets(by_source.drop("rate"), weights, max_epochs).join(by_source.select(F.col("source").alias("s"), "rate"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    targets = cut(
        targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumn("buckets", F.ceil(F.sqrt("n")))
    )
    here = lambda rows, per_source: rows.join(small(per_source.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    placed = here(keyed.select("source", "mix_size", "mix_key"), targets.select("source", "rate", "buckets")).withColumn("bucket", bucket())
    order = Window.partitionBy("source").orderBy("bucket")
    sums = placed.groupBy("source", "bucket").agg(F.sum("mix_size").alias("words")).withColumn("until", F.sum("words").over(order)).withColumn("start", F.col("until") - F.col("words"))
    # The first bucket that ends beyond the budget is the one that is cut.
    crossing = cut(
        here(sums, targets.select("source", "budget"))
        .filter((F.col("start") <= F.col("budget")) & (F.col("until") > F.col("budget")))
        .groupBy("source")
        .agg(F.min(F.struct("bucket", "start", "budget")).alias("c"))
        .select("source", F.col("c.bucket").alias("cut_bucket"), F.col("c.start").alias("start"), F.col("c.budget").alias("budget"))
    )
    inside = here(placed, crossing).filter(F.col("bucket") == F.col("cut_bucket"))
    until = F.col("start") + F.sum("mix_size").over(Window.partitionBy("source").orderBy("mix_key"))
    last = inside.withColumn("until", until).filter(F.col("until") - F.col("mix_size") / 2 <= F.col("budget")).groupBy("source").agg(F.max("mix_key").alias("cut_key"))
    cuts = crossing.select("source", "cut_bucket").join(last.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    cuts = targets.join(cuts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    return cut(cuts.select("source", "source_size", "target", "epochs", "rate", "buckets", "cut_bucket", "cut_key"))


def with_times(keyed: DataFrame, cuts: DataFrame) -> DataFrame:
    """keyed with what its source's row of cuts says, and mix_times: how often the mix takes the document."""
    named = cuts.withColumnRenamed("source", "s")
    joined = keyed.join(small(named), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("bucket", bucket())
    # Without a cut bucket the budget of the sample is the whole source (or all of it is empty).
    chosen = (F.col("bucket") < F.coalesce("cut_bucket", "buckets")) | ((F.col("bucket") == F.col("cut_bucket")) & (F.col("mix_key") <= F.col("cut_key")))
    return joined.withColumn("mix_times", F.col("epochs") + F.when(F.coalesce(chosen, F.lit(False)), 1).otherwise(0))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, salt: str = SALT) -> DataFrame:
    """doc_id, source, size, quality, source_size, target, times and taken (words, repeats counted) of every document."""
    keyed = cut(document_keys(docs.select("doc_id", "source", "text"), salt).drop("text"))
    out = with_times(keyed, source_cuts(keyed, weights, max_epochs))
    return out.select("doc_id", "source", F.col("mix_size").alias("size"), F.col("mix_quality").alias("quality"), "source_size", "target", F.col("mix_times").alias("times"), (F.col("mix_times") * F.col("mix_size")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, salt: str = SALT) -> DataFrame:
    """The mixed documents: each row as often as the mix takes it, with docs' own columns. Rows of no words are left out."""
    narrow = cut(document_keys(docs.select("doc_id", "source", "text"), salt).drop("text"))
    held = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("row"))  # names of docs' own can't clash then
    out = with_times(document_keys(held, salt), source_cuts(narrow, weights, max_epochs)).filter((F.col("mix_times") > 0) & (F.col("mix_size") > 0))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("mix_times").cast("int")))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "times")


SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    CASE WHEN length(text) > 0 THEN 0.25::DOUBLE + 0.75::DOUBLE * (length(regexp_replace(text, '[\\x21-\\x40\\x5b-\\x60\\x7b-\\x7e]+', '', 'g'))::DOUBLE / length(text)) ELSE 0.25::DOUBLE END AS q,
    ((('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT)::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((r - 1) % 3 + 1)::INT] AS weight, 3 * source_size AS cap, sum(source_size) OVER () AS total FROM s),
o AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (ORDER BY cap::DOUBLE / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM w),
f AS (SELECT *, cap::DOUBLE / weight <= lvl AS capped FROM o),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE weight * ((total - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0))::DOUBLE
    / sum(CASE WHEN NOT capped THEN weight END) OVER ()) END AS target FROM f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
k AS (SELECT d.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS budget,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(u) / q) AS until FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
x AS (SELECT *, (until - size / 2.0::DOUBLE <= budget AND budget > 0)::INT AS extra FROM k)
SELECT doc_id, size::BIGINT AS size, source_size, target, ((epochs + extra) * size)::BIGINT AS taken, (epochs + extra)::BIGINT AS times FROM x
"""
