"""Toxicity by the nearest labelled examples.

Terms are runs of letters in lower case. Those that labelled toxic documents have far more often than clean
ones (likelihood ratio over at most LABELLED labelled documents outside the held-out fold, those of least
hash) span the space, at most TERMS. Over all words of a text the cosine is that of its subject, and its neighbours say
little of its label (README.md has the figures). Document frequencies and so the TF-IDF weights come from all
documents. At most EXAMPLES labelled documents with any of the terms, again those of least hash, are the
examples; all three bounds are parameters.

Examples lie in an inverted index: each term has its postings, in order of the examples, and for each block of examples with the
term its largest weight there. A document's terms give an upper bound of its cosine with any example of a block; blocks are
scored in the order of their bounds until no bound exceeds the k-th cosine found, so the k nearest are exact. Votes are weighted
by squared cosine and drawn towards the share of toxic labels. A cosine says which terms a document has, not how much of it they
are, so a logistic curve of the vote and of the terms in a thousand words (logarithm of 1 + that) gives the score; it is fitted on the
examples themselves, each without its own vote. The nearest examples are returned as evidence.

Labels of documents with crc32(doc_id) mod 3 = 1 are held out and never seen in fitting.

Nulls: a null text counts as empty; a document with none of the terms has no neighbours and gets the
calibrated share. Without labels of both kinds every score is the share of label 1, or 0 without labels.
Rows with a null doc_id are scored and not held out. Very long texts count whole. Ties of cosines go to the smaller doc_id.
Repeated rows stay; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality_rules import held_out
from .shared import cut, table
from .token_ids import _Memory

LABELLED, TERMS, EXAMPLES, K, BLOCK, CUT = 40_000, 65_536, 4096, 15, 64, 0.7
FOLDS, HELD_OUT = 3, 1
#: Least likelihood ratio of a term, least toxic share of the labelled documents with it, and the votes that the overall share counts for.
LEAST_RATIO, LEAST_SHARE, PRIOR_VOTES = 12.0, 0.5, 0.3
RUN = re.compile(r"[^\W\d_]+").findall
VECTORS = "doc_id long, terms array<int>, counts array<int>, words long"
SCORES = "doc_id long, score double, evidence array<struct<doc_id: long, cosine: double, toxic: int>>"


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, y) of the labels that may be learned from."""
    i = F.col("doc_id").cast("long")
    return labels.select(i.alias("doc_id"), F.col("toxic").cast("int").alias("y")).filter(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), FOLDS, HELD_OUT))


def likelihood_ratio(a: Column, b: Column, n_a: float, n_b: float) -> Column:
    """G2 of a term that a of n_a toxic and b of n_b clean documents have; 0 if it is not more frequent in toxic
    ones, or most of the documents with it are clean."""
    share = (a + b) / F.lit(n_a + n_b)
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    g = 2 * (part(a, share * n_a) + part(b, share * n_b) + part(n_a - a, (1 - share) * n_a) + part(n_b - b, (1 - share) * n_b))
    return F.when((a / n_a > b / n_b) & (a >= LEAST_SHARE * (a + b)), g).otherwise(0.0)


def vocabulary(docs: DataFrame, seen: DataFrame, most: int = TERMS, labelled: int = LABELLED) -> list[str]:
    """Terms in order of their likelihood ratio, from at most `labelled` labelled documents."""
    # Of bounded size, so the texts need no shuffle. Repeated labels or rows of a document count once each.
    chosen = cut(seen.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(labelled))
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    n = chosen.agg(F.count_if(F.col("y") == 1).alias("a"), F.count_if(F.col("y") == 0).alias("b")).first()
    if not n["a"] or not n["b"]:
        return []
    words = F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^\\p{L}]+"))
    counts = labelled.select("y", F.explode(words).alias("term")).filter("term <> ''").groupBy("term").agg(F.count_if(F.col("y") == 1).alias("a"), F.count_if(F.col("y") == 0).alias("b"))
    ratio = likelihood_ratio(F.least("a", F.lit(n["a"])).cast("double"), F.least("b", F.lit(n["b"])).cast("double"), float(n["a"]), float(n["b"]))
    best = counts.filter("a > 1").select("term", ratio.alias("g")).filter(F.col("g") >= LEAST_RATIO).orderBy(F.desc("g"), "term").limit(most)
    return [r["term"] for r in best.collect()]


def _term_vectors(terms: list[str]):
    """For mapInArrow from (doc_id, text) to VECTORS."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: k for k, t in enumerate(terms)}
        memory = _Memory(lambda w: tuple(place[t] for t in RUN(w) if t in place), 200_000)
        for batch in batches:
            ids, counts, lengths = [], [], []
            for text in batch.column("text"):
                words = (text.as_py() or "").lower().split()
                found = Counter(t for hit in filter(None, map(memory.__getitem__, words)) for t in hit)
                ids.append(sorted(found))
                counts.append([found[t] for t in ids[-1]])
                lengths.append(len(words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32())), pa.array(lengths, pa.int64())], names=["doc_id", "terms", "counts", "words"])

    return run


def unit(terms: list[int], counts: list[int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A document's TF-IDF weights, (1 + log count) x idf, at length 1."""
    t = np.asarray(terms, dtype=np.int64)
    w = (1 + np.log(np.asarray(counts, dtype=float))) * idf[t]
    return t, w / np.sqrt((w * w).sum()) if len(t) else w


class BlockMaxIndex:
    """Postings of the examples by term, in blocks of examples, with each term's largest weight in each of its blocks."""

    def __init__(self, ids: np.ndarray, y: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK):
        # Examples with the same first term lie together, which makes the blocks' bounds tight.
        lead = np.array([int(t[np.argmax(w)]) if len(t) else n_terms for t, w in vectors])
        order = np.lexsort((ids, lead))
        self.ids, self.y, self.block = ids[order], y[order], block
        self.n_blocks = -(-len(ids) // block)
        found: dict[int, tuple[list[int], list[float]]] = {}
        for row, k in enumerate(order):
            for t, w in zip(*vectors[k], strict=True):
                rows, weights = found.setdefault(int(t), ([], []))
                rows.append(row)
                weights.append(float(w))
        self.postings = {}
        for t, (rows, weights) in found.items():
            rows, weights = np.array(rows), np.array(weights)
            blocks, first = np.unique(rows // block, return_index=True)
            self.postings[t] = (rows, weights, blocks, np.append(first, len(rows)), np.maximum.reduceat(weights, first))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = K, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(rows, cosines) of the k examples of largest cosine above 0, ties to the smaller id."""
        asked = [(w, self.postings[int(t)]) for t, w in zip(terms, weights, strict=True) if int(t) in self.postings]
        bounds = np.zeros(self.n_blocks)
        for w, (_, _, blocks, _, most) in asked:
            bounds[blocks] += w * most
        rows, cosines, least = np.zeros(0, np.int64), np.zeros(0), 0.0
        for b in np.argsort(-bounds, kind="stable"):
            if bounds[b] <= 0 or len(rows) >= k and bounds[b] < least - 1e-12:
                break
            c = np.zeros(self.block)
            for w, (at, own, blocks, first, _) in asked:
                i = np.searchsorted(blocks, b)
                if i < len(blocks) and blocks[i] == b:
                    c[at[first[i] : first[i + 1]] - b * self.block] += w * own[first[i] : first[i + 1]]
            fine = b * self.block + np.flatnonzero(c > 0)
            if without is not None:
                fine = fine[self.ids[fine] != without]
            rows, cosines = np.append(rows, fine), np.append(cosines, c[fine - b * self.block])
            if len(rows) > k:
                top = np.lexsort((self.ids[rows], -np.round(cosines, 12)))[:k]
                rows, cosines = rows[top], cosines[top]
            if len(rows) == k:
                least = cosines.min()
        top = np.lexsort((self.ids[rows], -np.round(cosines, 12)))
        return rows[top], cosines[top]


def votes(y: np.ndarray, cosines: np.ndarray, share: float) -> float:
    w = cosines**2
    return float(((w * y).sum() + PRIOR_VOTES * share) / (w.sum() + PRIOR_VOTES))


def density(counts: list[int], words: int) -> float:
    """Logarithm of 1 + the terms in a thousand words."""
    return float(np.log1p(1000 * sum(counts) / max(1, words)))


def logistic_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights w of 1 / (1 + exp(-(w[0] + w[1:] x))) by Newton steps; they are kept from running off where x separates y."""
    one = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(one.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(one @ w, -30, 30)))
        h = one.T @ (one * np.maximum(p * (1 - p), 1e-9)[:, None]) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, one.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def calibrated(curve: np.ndarray, vote: float, dense: float) -> float:
    return float(1 / (1 + np.exp(-(curve[0] + curve[1] * vote + curve[2] * dense))))


def _scores(model: dict):
    """For mapInArrow from VECTORS to SCORES."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = BlockMaxIndex(model["ids"], model["y"], model["vectors"], len(model["idf"]))
        for batch in batches:
            scores, evidence = [], []
            for terms, counts, words in zip(*(batch.column(c).to_pylist() for c in ("terms", "counts", "words")), strict=True):
                rows, cosines = index.nearest(*unit(terms, counts, model["idf"])) if terms else (np.zeros(0, np.int64), np.zeros(0))
                scores.append(calibrated(model["curve"], votes(index.y[rows], cosines, model["share"]), density(counts, words)))
                evidence.append([{"doc_id": int(index.ids[r]), "cosine": float(c), "toxic": int(index.y[r])} for r, c in zip(rows[:3], cosines[:3], strict=True)])
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(evidence, kind)], names=["doc_id", "score", "evidence"])

    return run


def fit(vectors: DataFrame, seen: DataFrame, n_terms: int, examples: int = EXAMPLES) -> dict:
    """Weights over all documents, the examples, and the calibration."""
    df = np.zeros(n_terms)
    for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most TERMS rows
        df[r["t"]] = r["count"]
    idf = np.log((1 + vectors.count()) / (1 + df)) + 1
    counts = seen.agg(F.count("*").alias("n"), F.avg("y").alias("share")).first()
    known = vectors.join(seen, "doc_id")
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("y")]
    with_terms = known.filter(F.size("terms") > 0)
    rows = with_terms.orderBy(*order).limit(examples).collect()
    some = with_terms.agg(F.count("*").alias("n")).first()["n"]
    blank = known.filter(F.size("terms") == 0).agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("y")).first()
    model = {"idf": idf, "share": counts["share"], "ids": np.array([r["doc_id"] for r in rows], np.int64), "y": np.array([r["y"] for r in rows], float), "vectors": [unit(r["terms"], r["counts"], idf) for r in rows]}
    index = BlockMaxIndex(model["ids"], model["y"], model["vectors"], n_terms)
    vote = [votes(index.y[n], c, model["share"]) for i, v in zip(model["ids"], model["vectors"], strict=True) for n, c in [index.nearest(*v, without=int(i))]]
    x = [(v, density(r["counts"], r["words"])) for v, r in zip(vote, rows, strict=True)]
    # Documents without any term stand for themselves in the right proportion to the sampled examples.
    m = max(2, round(blank["n"] * len(rows) / max(1, some)))
    toxic = round(m * (blank["y"] / max(1, blank["n"])))
    x = np.array([*x, *[(model["share"], 0.0)] * m])
    model["curve"] = logistic_curve(x, np.array([*model["y"], *[1.0] * toxic, *[0.0] * (m - toxic)]))
    return model


def score_documents(docs: DataFrame, labels: DataFrame, terms: int = TERMS, examples: int = EXAMPLES) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence of every document."""
    seen = cut(training_labels(labels))
    words = vocabulary(docs, seen, terms)
    if not words:
        share = seen.agg(F.avg("y")).first()[0] or 0.0
        out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(float(share)).alias("score"), F.lit(None).cast(SCORES.split("evidence ")[1]).alias("evidence"))
    else:
        vectors = cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_term_vectors(words), VECTORS))
        out = vectors.mapInArrow(_scores(fit(vectors, seen, len(words), examples)), SCORES)
    return out.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "evidence")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
