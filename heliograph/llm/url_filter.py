"""URL filter: rules where one fits, else gradient-boosted trees on lexical features of the URL.

The URLs that a rule decides are the labelled ones. Suffix statistics are the share of blocked URLs among
the labelled ones of a host's last label and of its last two (for a labelled URL without itself), counted
over all pages. Trees are fitted on a sample of labelled URLs, bounded by SAMPLE, and become nested
conditions on columns, so every page is scored by Spark alone.

Nulls: a URL that is null or has no `://` has an empty host and path, fits no rule, and is judged by its
other features (all 0 for null). Where all labelled URLs have one verdict, or none is labelled, the rest
are allowed. Repeated rows and a null page_id stay as they are. Other columns are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import trees
from .shared import ascii_lower, cut, join_commonest_apart, table

#: (verdict, host, path): a rule fits its host and subdomains where the path starts with its own.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Labelled URLs that the trees are fitted on, at most.
SAMPLE = 20_000
ROUNDS, DEPTH, CUT = 30, 3, 0.5
#: Weight of the overall share in a suffix's statistics.
PRIOR = 5.0
FEATURES = ("n_chars", "host_chars", "depth", "labels", "digits", "entropy", "parameters", "hyphens", "last_label_rate", "last_two_rate")


def split_url(pages: DataFrame) -> DataFrame:
    """page_id, url, host and path."""
    url = F.coalesce("url", F.lit(""))
    return pages.select("page_id", "url", ascii_lower(F.regexp_extract(url, "(?s)://([^/?#]*)", 1)).alias("host"), F.regexp_extract(url, "(?s)://[^/?#]*([^?#]*)", 1).alias("path"))


def with_rule(urls: DataFrame, rules: tuple = RULES) -> DataFrame:
    """rule and rule_verdict of the longest rule that fits, null without one."""
    verdict = name = None
    for says, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        name = F.when(fits, f"{host}{path}") if name is None else name.when(fits, f"{host}{path}")
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return urls.withColumn("rule", name).withColumn("rule_verdict", verdict)


def count_of(c: Column, sign: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(sign), F.lit("")))


def entropy(c: Column) -> Column:
    """Bits a character of the distribution of c's characters."""
    n = F.length(c)
    part = lambda x: (n - F.length(F.replace(c, x, F.lit("")))) / n
    return F.when(n > 0, F.aggregate(F.array_distinct(F.filter(F.split(c, ""), lambda x: x != "")), F.lit(0.0), lambda acc, x: acc - part(x) * F.log2(part(x)))).otherwise(F.lit(0.0))


def lexical(urls: DataFrame) -> DataFrame:
    """urls with the features that a URL has by itself, and its suffixes."""
    url = F.coalesce("url", F.lit(""))
    digits = F.length(url) - F.length(F.translate(url, "0123456789", ""))
    return (
        urls.withColumn("n_chars", F.length(url).cast("double"))
        .withColumn("host_chars", F.length("host").cast("double"))
        .withColumn("depth", count_of(F.col("path"), "/").cast("double"))
        .withColumn("labels", count_of(F.col("host"), ".").cast("double"))
        .withColumn("digits", F.when(F.length(url) > 0, digits / F.length(url)).otherwise(F.lit(0.0)))
        .withColumn("entropy", F.round(entropy(url), 9))
        .withColumn("parameters", count_of(url, "=").cast("double"))
        .withColumn("hyphens", count_of(url, "-").cast("double"))
        .withColumn("last_label", F.substring_index("host", ".", -1))
        .withColumn("last_two", F.substring_index("host", ".", -2))
        .withColumn("y", F.when(F.col("rule_verdict") == "block", 1.0).when(F.col("rule_verdict") == "allow", 0.0))
    )


def with_suffix_rates(urls: DataFrame) -> DataFrame:
    """urls with last_label_rate and last_two_rate."""
    overall = urls.agg(F.avg("y")).first()[0]
    overall = 0.5 if overall is None else overall
    for suffix in ("last_label", "last_two"):
        known = cut(urls.groupBy(suffix).agg(F.count("*").alias("times"), F.count("y").alias("n"), F.sum("y").alias("blocked")))
        urls = join_commonest_apart(urls, known, suffix, "times")
        own = F.when(F.col("y").isNotNull(), 1).otherwise(0)
        rate = (F.coalesce("blocked", F.lit(0.0)) - F.coalesce("y", F.lit(0.0)) + PRIOR * overall) / (F.coalesce("n", F.lit(0)) - own + PRIOR)
        urls = urls.withColumn(f"{suffix}_rate", rate).drop("n", "blocked")
    return urls


def fit(urls: DataFrame, sample: int = SAMPLE) -> tuple[float, list] | None:
    """Boosted trees for block, from at most `sample` labelled URLs (those of least hash); None without both verdicts."""
    order = F.xxhash64(F.col("page_id"), F.col("url"))
    rows = urls.filter("y is not null").orderBy(order, "page_id", "url").limit(sample).select("y", *FEATURES).toPandas()
    if rows["y"].nunique() < 2:
        return None
    x = np.column_stack([rows[c].to_numpy(float) for c in FEATURES])
    return trees.boost(x, rows["y"].to_numpy(float), ROUNDS, DEPTH)


def judge(pages: DataFrame, rules: tuple = RULES, sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict and the trees' score of every page."""
    urls = with_suffix_rates(cut(lexical(with_rule(split_url(pages), rules))))  # features are made once, not for every pass
    model = fit(urls, sample)
    if model is None:
        score = F.lit(0.0)
    else:
        start, grown = model
        odds = F.lit(start)
        for tree in grown:
            odds = odds + trees.column(tree, [F.col(c) for c in FEATURES])
        score = 1 / (1 + F.exp(-odds))
    urls = urls.withColumn("score", score)
    own = F.when(F.col("score") >= CUT, "block").otherwise("allow")
    return urls.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
