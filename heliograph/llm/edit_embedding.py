"""Document fingerprints by a randomised edit embedding.

A shared random walk reads a text: at step j it puts out the character it stands on and moves on to the
next one if the coin for (j, character) says so. Walks over texts that differ by few edits fall into step
again soon after each edit, so the edit distance of the texts becomes a Hamming distance of the outputs.
A character is met at step j and left after the next step whose coin for it is 1, so a walk takes one
table look-up a character; a batch of texts walks together. Coins repeat after PERIOD steps.

The fingerprint samples the output: each of 256 bins of steps holds the step of least hash below twice the
text's length, and puts out four bits of a hash of the character there, as one hex digit. Texts of nearly
the same length sample nearly the same steps. Likeness is the part of equal digits. `near_pairs` finds
candidates by bands of eight digits that are equal, more and narrower ones if need be: there are more bands than
digits in which a pair of the least likeness differs, so that none is missed. Candidates are verified by
likeness and by the edit distance of their whole texts.

Nulls: a null text is empty, and its digits are all 0; equal texts have equal fingerprints. Repeated rows
stay; rows with a null doc_id come first in the order of documents. The one document of a table is its own
next. An empty table gives an empty result. Other columns are left out.
"""

from __future__ import annotations

import functools
import hashlib
import math
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, table

BINS, PERIOD, KINDS, SEED = 256, 4096, 64, 7
#: Code points that walk together; bounds a task's memory at about 25 bytes each.
BATCH = 8_000_000
#: Digits of a band.
BAND = 8
#: Least likeness of a near pair, and its greatest edit distance as a part of the longer text's length.
LIKENESS, DISTANCE = 0.88, 0.1
#: About so many texts of a band's key are a block; each two blocks are compared by themselves.
BLOCK = 128
NEAR = "a_id long, b_id long, likeness double, distance long"
#: Text bytes of a range of documents that one task takes in order.
RANGE_BYTES = 24 << 20
#: Ranges at most, whose marks go to every task (half a megabyte); beyond 1.5 TB of text ranges get longer, and their sorts spill.
MOST_RANGES = 65_536
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, next_id long"


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of whole numbers."""
    with np.errstate(over="ignore"):
        x = (x.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


@functools.lru_cache(maxsize=2)
def coins(seed: int = SEED) -> np.ndarray:
    """after[kind * PERIOD + j % PERIOD]: steps from j until a character of this kind, met at j, is left."""
    toss = (mixed(np.arange(KINDS * PERIOD), seed) >> np.uint64(40)) & np.uint64(1)
    toss = toss.reshape(KINDS, PERIOD).astype(np.int64)
    out = np.zeros((KINDS, PERIOD), np.int32)
    wait = np.ones(KINDS, np.int64)
    for j in [*range(PERIOD - 1, -1, -1)] * 2:  # the second round knows what follows the last step
        wait = np.where(toss[:, j] == 1, 1, wait + 1)
        out[:, j] = wait
    return out.ravel()


class _Steps:
    """The sampled steps for a length, from the low records of each bin's hashes; grown as lengths come."""

    def __init__(self, seed: int):
        self.seed, self.upto = seed, 0
        self.least = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
        self.records: list[list[int]] = [[] for _ in range(BINS)]
        self.padded = np.zeros((BINS, 0), np.int64)

    def _grow(self, upto: int) -> None:
        h = mixed(np.arange(self.upto, upto), self.seed + 1)
        bins = (h & np.uint64(BINS - 1)).astype(np.int64)
        for b in range(BINS):
            at = np.flatnonzero(bins == b)
            if len(at):
                low = np.minimum.accumulate(np.append(self.least[b], h[at]))
                self.records[b] += (self.upto + at[np.flatnonzero(low[1:] < low[:-1])]).tolist()
                self.least[b] = low[-1]
        self.upto = upto
        wide = max(map(len, self.records))
        self.padded = np.array([x + [1 << 60] * (wide - len(x)) for x in self.records], np.int64)

    @functools.lru_cache(maxsize=4096)  # noqa: B019
    def below(self, length: int) -> np.ndarray:
        """One step below length for each bin; an empty bin takes that of the next one that has any."""
        if length > self.upto:
            self._grow(max(2 * self.upto, length, 1 << 14))
        n = (self.padded < length).sum(1)
        own = np.flatnonzero(n)
        steps = self.padded[np.arange(BINS), np.maximum(n - 1, 0)]
        return steps[own[np.searchsorted(own, np.arange(BINS)) % len(own)]]


@functools.lru_cache(maxsize=2)
def sampled(seed: int = SEED) -> _Steps:
    return _Steps(seed)


def kinds_of(codes: np.ndarray, seed: int = SEED) -> np.ndarray:
    """The coin tables' row of each code point."""
    return ((mixed(codes, seed + 2) >> np.uint64(33)) % np.uint64(KINDS)).astype(np.int32)


def walk(kinds: np.ndarray, offsets: np.ndarray, start: np.ndarray | None = None, seed: int = SEED) -> np.ndarray:
    """The step at which each character of each text is met. Text t is kinds[offsets[t]:offsets[t + 1]]; it
    begins at step start[t]."""
    after, sizes = coins(seed), np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    sizes, first = sizes[order], offsets[:-1][order]
    j = np.zeros(len(order), np.int32) if start is None else start[order].astype(np.int32)
    met = np.empty(len(kinds), np.int32)
    rows = kinds * np.int32(PERIOD)
    longest = int(sizes[0]) if len(sizes) else 0
    going = np.searchsorted(-sizes, -np.arange(longest), side="left")  # texts longer than i
    for i in range(longest):
        a = int(going[i])
        at = first[:a] + i
        now = j[:a]
        met[at] = now
        now += after[rows[at] + (now & (PERIOD - 1))]
    return met


def digits(codes: np.ndarray, met: np.ndarray, n: int, end: int, seed: int = SEED) -> np.ndarray:
    """The fingerprint of a text of n code points, which met them at these steps and ended at step end."""
    if n == 0:
        return np.zeros(BINS, np.uint8)
    steps = sampled(seed).below(2 * n)
    at = np.searchsorted(met, steps, side="right") - 1
    out = ((mixed(codes[at], seed + 3) >> np.uint64(37)) & np.uint64(15)).astype(np.uint8)
    return np.where(steps < end, out, np.uint8(0))


def as_hex(x: np.ndarray) -> str:
    return "".join(map("0123456789abcdef".__getitem__, x.tolist()))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def walks(texts: list[np.ndarray], start: np.ndarray | None = None, seed: int = SEED) -> tuple[list[np.ndarray], np.ndarray]:
    """The steps of each text's characters, and the step at which each walk ends."""
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
    codes = np.concatenate(texts) if texts else np.zeros(0, np.uint32)
    kinds = kinds_of(codes, seed)
    met = walk(kinds, offsets, start, seed)
    out = [met[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    left = np.zeros(len(texts), np.int64) if start is None else start.astype(np.int64).copy()
    for t, m in enumerate(out):
        if len(m):
            last = int(m[-1])
            left[t] = last + coins(seed)[int(kinds[offsets[t + 1] - 1]) * PERIOD + (last & (PERIOD - 1))]
    return out, left


def fingerprint(texts: list[str | None], seed: int = SEED) -> list[np.ndarray]:
    codes = [code_points(x or "") for x in texts]
    met, end = walks(codes, None, seed)
    return [digits(c, m, len(c), int(e), seed) for c, m, e in zip(codes, met, end, strict=True)]


def _with_next(rows: list[tuple[int | None, str]], seed: int) -> list[tuple]:
    """RESULT of all rows but the last, whose next is each time the row after it."""
    texts = [x or "" for _, x in rows]
    codes = [code_points(x) for x in texts]
    met, end = walks(codes, None, seed)
    prints = [digits(c, m, len(c), int(e), seed) for c, m, e in zip(codes, met, end, strict=True)]
    kept = [len(c) - len(c) // 4 for c in codes[:-1]]
    tails = [codes[t + 1][: len(codes[t]) // 4] for t in range(len(kept))]
    # The walk over the unchanged part is the same; only the new tail is walked.
    begin = np.array([int(met[t][k]) if k < len(met[t]) else int(end[t]) for t, k in enumerate(kept)], np.int64)
    tail_met, tail_end = walks(tails, begin, seed)
    out = []
    for t, k in enumerate(kept):
        new = np.concatenate([codes[t][:k], tails[t]])
        own = digits(new, np.concatenate([met[t][:k], tail_met[t]]), len(new), int(tail_end[t]) if len(tails[t]) else int(begin[t]), seed)
        edited = texts[t][:k] + texts[t + 1][: len(codes[t]) // 4]
        out.append((rows[t][0], len(codes[t]), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_hex(prints[t]), as_hex(own), float((prints[t] == own).mean()), float((prints[t] == prints[t + 1]).mean()), rows[t + 1][0]))
    return out


def _in_order(seed: int):
    """For mapInArrow over sorted ranges (part, last, doc_id, text): a row with last is only the next one of
    the range's last document."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "next_id"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]

    def batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str]] = []
        size = 0
        for b in batches:
            for doc_id, last, text in zip(b.column("doc_id").to_pylist(), b.column("last").to_pylist(), b.column("text"), strict=True):
                held.append((doc_id, text.as_py() or ""))
                size += len(held[-1][1])
                if len(held) > 1 and (last or size > BATCH):
                    yield batch(_with_next(held, seed))
                    held, size = ([], 0) if last else (held[-1:], len(held[-1][1]))

    return run


def range_of(marks: list[int]):
    """A function of a column: the number of marks below it, 0 for null."""
    ordered = np.array(marks, np.int64)

    @F.pandas_udf("int")
    def place(c: pd.Series) -> pd.Series:
        known = c.notna().to_numpy()
        out = np.zeros(len(c), np.int32)
        out[known] = np.searchsorted(ordered, c[known].to_numpy(np.int64), side="left")
        return pd.Series(out)

    return place


def with_edited(docs: DataFrame, range_bytes: int = RANGE_BYTES, seed: int = SEED) -> DataFrame:
    """RESULT for every document: its fingerprint, and that of its text with the last quarter replaced by the
    start of the next document's, in ascending doc_id.

    Documents are dealt by ranges of doc_id and sorted there; each range also gets the first document of the
    next one (of the first range, for the last), one row a range, so nothing is ordered in one task."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    stats = rows.agg(F.sum(F.octet_length("text")).alias("n"), F.count("*").alias("rows")).first()
    if not stats["rows"]:
        return docs.sparkSession.createDataFrame([], RESULT)
    n = min(stats["rows"], max(4 * docs.sparkSession.sparkContext.defaultParallelism, math.ceil((stats["n"] or 0) / range_bytes)), MOST_RANGES)
    ids = rows.select("doc_id").filter("doc_id is not null")
    marks = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], max(10_000, 20 * n)).alias("m")).first()["m"]
    marks = sorted(set(marks or []))
    placed = rows.withColumn("part", range_of(marks)("doc_id"))
    order = F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", F.xxhash64("text").alias("h"))
    firsts = placed.groupBy("part").agg(F.min(order).alias("o"))
    around = Window.orderBy("part")  # one row a range
    firsts = firsts.withColumn("to", F.coalesce(F.lag("part").over(around), F.max("part").over(Window.partitionBy())))
    firsts = cut(firsts)
    first_rows = (
        placed.withColumn("o", order)
        .join(F.broadcast(firsts.select("part", "o", "to")), ["part", "o"])
        .groupBy("to")
        .agg(F.min_by(F.struct("doc_id", "text"), "o").alias("r"))
        .select(F.col("to").alias("part"), F.lit(True).alias("last"), "r.doc_id", "r.text")
    )
    dealt = placed.select("part", F.lit(False).alias("last"), "doc_id", "text").unionByName(first_rows)
    dealt = dealt.repartitionById(len(marks) + 1, "part").sortWithinPartitions("part", "last", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return dealt.select("doc_id", "last", "text").mapInArrow(_in_order(seed), RESULT)


def bands(likeness: float) -> list[tuple[int, int]]:
    """(first, end) of each band: one more at least than digits in which two texts of this likeness differ."""
    if not 0 < likeness <= 1:
        raise ValueError("likeness must be above 0, and 1 at most")
    n = max(BINS // BAND, math.floor((1 - likeness) * BINS + 1e-9) + 1)
    return [(b * BINS // n, (b + 1) * BINS // n) for b in range(n)]


def edit_distance(a: str, b: str) -> int:
    """Least number of characters put in, taken out or changed, by whole columns of the table as bits of one number."""
    lead = len(os.path.commonprefix([a, b]))
    a, b = a[lead:], b[lead:]
    tail = len(os.path.commonprefix([a[::-1], b[::-1]]))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    every, top, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    more, less = every, 0
    for c in b:
        eq = at.get(c, 0)
        down = eq | less
        across = (((eq & more) + more) ^ more) | eq
        up, low = less | (every & ~(across | more)), more & across
        score += bool(up & top) - bool(low & top)
        up, low = up << 1 | 1, low << 1
        more, less = (low | ~(down | up)) & every, up & down & every
    return score


def _prints(seed: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            ends = np.cumsum([len(x or "") for x in texts]) // BATCH
            for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends)) + 1):
                own = [texts[i] or "" for i in part]
                nodes = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).digest() for x in own]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(part)), pa.array(nodes, pa.binary()), pa.array([as_hex(x) for x in fingerprint(own, seed)], pa.string())], names=["doc_id", "node", "fp"])

    return run


def _alike(parts: list[tuple[int, int]], likeness: float):
    """For mapInArrow over (band, x, y, members): pairs of a member of block x and one of y that are alike and
    have no earlier band in common, so that each pair comes once."""
    starts, need = [a for a, _ in parts], math.ceil(likeness * BINS - 1e-9)

    def pairs(band: int, x: int, y: int, members: list[dict]) -> Iterator[tuple[bytes, bytes, float]]:
        fps = np.array([np.frombuffer(m["fp"].encode(), np.uint8) for m in members])
        own = np.array([m["own"] for m in members])
        right = np.flatnonzero(own == y)
        for i in np.flatnonzero(own == x):
            others = right[right > i] if x == y else right
            same = fps[others] == fps[i]
            good = same.sum(1) >= need
            first = np.logical_and.reduceat(same[good], starts, axis=1).argmax(1)
            for j, n in zip(others[good][first == band], same[good].sum(1)[first == band], strict=True):
                yield members[i]["node"], members[j]["node"], n / BINS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = list(pairs(row["band"], row["x"], row["y"], row["members"]))
                if found:
                    a, b, near = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(near, pa.float64())], names=["a", "b", "likeness"])

    return run


def _verified(distance: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                longer = max(len(r["s"]), len(r["t"]))
                if longer - min(len(r["s"]), len(r["t"])) <= distance * longer and (d := edit_distance(r["s"], r["t"])) <= distance * longer:
                    out.append((min(r["a_id"], r["b_id"]), max(r["a_id"], r["b_id"]), r["likeness"], d))
            cols = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["a_id", "b_id", "likeness", "distance"])

    return run


def near_pairs(docs: DataFrame, likeness: float = LIKENESS, distance: float = DISTANCE, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """NEAR for all pairs of different texts with at least the likeness and at most the edit distance (a part of the
    longer text's length). Equal texts are one, under their least doc_id; rows with a null doc_id are left out.

    A band's key that many texts share is dealt in blocks of about `block` texts, two blocks to a row."""
    parts = bands(likeness)
    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    prints = rows.mapInArrow(_prints(seed), "doc_id long, node binary, fp string")
    nodes = cut(prints.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("fp").alias("fp")))
    band = [F.struct(F.lit(b).alias("band"), F.substring("fp", lo + 1, hi - lo).alias("digits")) for b, (lo, hi) in enumerate(parts)]
    keyed = nodes.select("node", "fp", F.explode(F.array(*band)).alias("k")).select("node", "fp", "k.*")
    crowds = keyed.groupBy("band", "digits").agg(F.count("*").alias("n")).filter("n > 1").select("band", "digits", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    placed = keyed.join(crowds, ["band", "digits"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.groupBy("band", "digits", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")).agg(F.collect_list(F.struct("node", "fp", "own")).alias("members"))
    found = cut(dealt.select("band", "x", "y", "members").mapInArrow(_alike(parts, likeness), "a binary, b binary, likeness double"))
    in_pairs = found.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    text = F.coalesce("text", F.lit(""))
    texts = rows.select(F.unhex(F.sha2(text, 256)).alias("node"), text.alias("text")).join(in_pairs, "node", "left_semi").dropDuplicates(["node"]).join(nodes.select("node", "doc_id"), "node")
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("s"), F.col("doc_id").alias("a_id"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("t"), F.col("doc_id").alias("b_id"))
    return found.join(one, "a").join(two, "b").select("a_id", "b_id", "likeness", "s", "t").mapInArrow(_verified(distance), NEAR)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edited(table(spark, sf_dir, "documents"))
