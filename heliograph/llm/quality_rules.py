"""Quality classifier: a sparse ensemble of rules over statistics of the text.

Boosted trees are grown on a bounded sample of labelled documents; every path from a root is a rule, a
conjunction of comparisons. A logistic regression with an L1 penalty weighs the rules, and most weights
become zero. The remaining rules are compiled into one Spark column, so every whole text is scored by
Spark's own expressions. Inputs are statistics of the text alone.

Labels of documents with crc32(doc_id) mod 4 = 2 are held out and never seen in fitting.

Nulls: a null text counts as empty; all statistics of an empty text are 0 and it is scored like others.
Without labels of both kinds the score is the share of label 1, or 0.5. Rows with a null doc_id are scored
and not held out. Very long texts are measured whole, and an empty table gives an empty result. Repeated rows and repeated labels stay as they are; a null label is none. Other columns
are left out by `score_documents` and kept by `keep_good`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import trees
from .shared import SPACE, table

#: Labelled documents that the rules are fitted on, at most: those of least hash.
SAMPLE = 12_000
ROUNDS, DEPTH, PENALTY, STEPS, CUT = 30, 3, 0.002, 400, 0.7
FOLDS, HELD_OUT = 4, 2
CAPITALS, SIGNS, STOPS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xDF)])), "!#$%&*|<>{}[]=~^_@\\/+", ".,;:?"


def held_out(doc_id: Column, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def statistics(text: Column) -> dict[str, Column]:
    """Statistics by name; they use the columns words and lines that with_statistics adds."""
    n = F.length(text)
    words, lines = F.col("words"), F.col("lines")
    n_words = F.size(words)
    per = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    without = lambda signs: F.length(F.translate(text, signs, ""))
    twins = F.size(F.filter(F.zip_with(words, F.slice(words, 2, F.greatest(n_words, F.lit(1))), lambda a, b: a == b), lambda x: x))
    return {
        "n_chars": n.cast("double"),
        "n_words": n_words.cast("double"),
        "word_length": per(n, n_words),
        "capitals": per(n - without(CAPITALS), n),
        "digits": per(n - without("0123456789"), n),
        "signs": per(n - without(SIGNS), n),
        "bangs": per(n - without("!"), n_words),
        "bars": per(n - without("|"), n_words),
        "stops": per(n - without(STOPS), n_words),
        "distinct_words": per(F.size(F.array_distinct(words)), n_words),
        "twin_words": per(twins, n_words),
        "distinct_lines": per(F.size(F.array_distinct(lines)), F.size(lines)),
        "words_a_line": per(n_words, F.size(lines)),
    }


NAMES = ("n_chars", "n_words", "word_length", "capitals", "digits", "signs", "bangs", "bars", "stops", "distinct_words", "twin_words", "distinct_lines", "words_a_line")


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs with one column `stats`, a struct of the statistics of the whole text."""
    kept = docs.columns
    text = F.coalesce("text", F.lit(""))
    split = docs.select("*", F.filter(F.split(text, SPACE), lambda w: w != "").alias("words"), F.filter(F.split(text, "\n"), lambda x: x != "").alias("lines"))
    stats = statistics(text)
    return split.select(*kept, F.struct(*(F.round(c, 9).alias(k) for k, c in stats.items())).alias("stats"))


def soft(x: np.ndarray, by: float) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - by, 0)


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """(intercept, weights) of a logistic regression with an L1 penalty on the weights, by accelerated
    proximal gradient steps."""
    one = np.column_stack([np.ones(len(x)), x])
    step = 4 * len(x) / max(1e-9, np.linalg.norm(one, 2) ** 2)
    w = v = np.zeros(one.shape[1])
    t = 1.0
    for _ in range(steps):
        grad = one.T @ (1 / (1 + np.exp(-(one @ v))) - y) / len(x)
        new = v - step * grad
        new[1:] = soft(new[1:], step * penalty)
        ahead = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / ahead * (new - w), new, ahead
    return float(w[0]), w[1:]


def fires(rule: tuple, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, at_most, threshold in rule:
        out &= x[:, f] <= threshold if at_most else x[:, f] > threshold
    return out


def fit_rules(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[tuple, float]]]:
    """(intercept, [(rule, weight)]) with the rules whose weight is not zero."""
    _, grown = trees.boost(x, y, ROUNDS, DEPTH)
    rules = list(dict.fromkeys(p for tree in grown for p in trees.paths(tree)))
    fired = np.column_stack([fires(r, x) for r in rules]).astype(float) if rules else np.zeros((len(x), 0))
    _, first = np.unique(fired, axis=1, return_index=True)  # rules that fire on the same rows count once
    first = np.sort(first)
    base, weights = lasso_logistic(fired[:, first], y)
    return base, [(rules[i], float(w)) for i, w in zip(first, weights, strict=True) if abs(w) > 1e-6]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[float, list]:
    """Rules from at most `sample` labelled documents outside the held-out fold. The labels are cut down first,
    so only the sampled texts are read through the join and measured."""
    seen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).filter(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = seen.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    # One doc_id may stand on any number of rows, so the joined rows are held to the bound as well.
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id", "text"), "doc_id", "y").limit(sample)
    found = with_statistics(known).select("doc_id", "y", "stats.*")
    rows = found.toPandas().sort_values(["doc_id", "y", *NAMES])
    y = rows["y"].to_numpy(float)
    if len(set(y)) < 2:
        p = min(max(y.mean() if len(y) else 0.5, 0.01), 0.99)
        return float(np.log(p / (1 - p))), []
    return fit_rules(rows[list(NAMES)].to_numpy(float), y)


def score_column(model: tuple[float, list], stats: str = "stats") -> Column:
    """The score, 0 to 1, as one expression over the statistics."""
    odds = F.lit(model[0])
    for rule, weight in model[1]:
        fired = F.lit(True)
        for f, at_most, threshold in rule:
            c = F.col(f"{stats}.{NAMES[f]}")
            fired = fired & (c <= threshold if at_most else c > threshold)
        odds = odds + F.when(fired, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = with_statistics(docs.select("doc_id", "text")).select("doc_id", score_column(fit(docs, labels, sample)).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT, sample: int = SAMPLE) -> DataFrame:
    """The documents whose score is at least cut, with docs' own columns."""
    held = docs.select(F.struct(*docs.columns).alias("row"), "text")
    model = fit(docs, labels, sample)
    return with_statistics(held).filter(score_column(model) >= cut).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
