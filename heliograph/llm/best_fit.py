"""Best-fit packing of whole documents into sequences of a fixed number of tokens, large ones matched first.

Pieces above a third of the capacity are large: no sequence holds more than two of them. They are matched
greedily, from the longest down, each with the longest large piece that still fits beside it, which gives the
fewest sequences for them. Smaller pieces, from the longest down, go where they leave the smallest gap, and
into new sequences where no gap holds them. Only documents above the capacity are cut, into full pieces and a
rest.

Lengths are whole numbers up to the capacity, so equal lengths are treated together: `plan` works on the
counts of each length (at most `capacity` numbers, whatever the input) and on runs of sequences with equal
gaps, a run giving the same result as its sequences one by one. Its rows say where the pieces of a length go,
by their number within the length; they too are bounded by the capacity alone, as a run at least halves its
gap each time it is filled. Pieces are numbered within their task and length, tasks get the sum of the tasks
before them, and every piece then finds its place by itself.

Nulls: a null text is empty, and its one piece is the end id. Rows with a null doc_id and repeated rows are
packed like others. Very long texts are encoded whole. Ties: equal lengths are numbered by task and row.
An empty table gives an empty result. Columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, table
from .token_ids import default_tokenizer, document_ids

CAPACITY, END_ID = 4096, 1
PIECES = "doc_id long, piece long, start long, length long, ids_crc32 long, task long, number long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: Above any number of pieces of one length, so that length and number make one sortable key.
MOST = 1 << 45


def match_large(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, ...]], dict[int, list[list[int]]], int]:
    """Plan rows of the large lengths, the runs [first sequence, sequences] that they leave by gap, and the sequences used."""
    left = {n: c for n, c in counts.items() if 3 * n > capacity and c}
    lengths, rows, runs, used, taken = sorted(left), [], {}, 0, dict.fromkeys(left, 0)

    def put(n: int, bins: int, first: int, per: int, offset: int) -> None:
        rows.append((n, taken[n], first, per, offset))
        taken[n] += bins * per
        left[n] -= bins * per
        if not left[n]:
            lengths.remove(n)

    while lengths:
        n = lengths[-1]
        at = bisect.bisect_right(lengths, capacity - n) - 1
        other = lengths[at] if at >= 0 else 0
        bins = left[n] if not other else min(left[n], left[other]) if other != n else left[n] // 2
        if not bins:  # one piece of a length that pairs with itself: the next shorter one, if any
            other = lengths[at - 1] if at else 0
            bins = 1
        if other == n:
            put(n, bins, used, 2, 0)
        else:
            put(n, bins, used, 1, 0)
            if other:
                put(other, bins, used, 1, n)
        runs.setdefault(capacity - n - other, []).append([used, bins])
        used += bins
    return rows, runs, used


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first number, first sequence, pieces per sequence, offset): from that number on, pieces of the length
    fill the sequences one after the other, so many in each, from the offset on."""
    rows, runs, used = match_large(counts, capacity)
    gaps = sorted(runs)

    def leave(gap: int, first: int, bins: int) -> None:
        if gap and bins:
            if gap not in runs:
                bisect.insort(gaps, gap)
            runs.setdefault(gap, []).append([first, bins])

    if gaps and gaps[0] == 0:
        gaps.pop(0)
        del runs[0]
    for n in sorted((n for n, c in counts.items() if 3 * n <= capacity and c), reverse=True):
        todo, number = counts[n], 0
        while todo:
            at = bisect.bisect_left(gaps, n)
            gap = gaps[at] if at < len(gaps) else capacity
            per = gap // n
            if at < len(gaps):
                first, there = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap]
                    gaps.pop(at)
            else:
                first, there = used, -(-todo // per)
                used += there
            full = min(there, todo // per)
            rest = todo - full * per if full < there else 0  # pieces that fill one more sequence in part
            rows.append((n, number, first, per, capacity - gap))
            leave(gap - per * n, first, full)
            if rest:
                leave(gap - rest * n, first + full, 1)
            leave(gap, first + full + bool(rest), there - full - bool(rest))
            todo -= full * per + rest
            number += full * per + rest
    return rows


def cut_documents(tokenizer: str, capacity: int, end_id: int):
    """A function for mapInArrow from (doc_id, text) to PIECES; number counts a length's pieces within the task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        names = [x.split()[0] for x in PIECES.split(", ")]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = document_ids(tokenizer, text.as_py(), end_id)
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    own = ids[start : start + capacity]
                    rows.append((doc_id, piece, start, len(own), zlib.crc32(own.tobytes()), task, seen[len(own)]))
                    seen[len(own)] += 1
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=names)

    return run


def place(rows: list[tuple[int, int, int, int, int]]):
    """A function for mapInArrow that gives pieces, numbered within their lengths, their sequences and offsets."""
    length, number, first, per, offset = (np.array(x, dtype="int64") for x in zip(*sorted(rows), strict=True)) if rows else [np.zeros(0, dtype="int64")] * 5
    keys = length * MOST + number

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            at = np.searchsorted(keys, n * MOST + k, side="right") - 1
            beyond = k - number[at]
            own = {"sequence_id": first[at] + beyond // per[at], "offset": offset[at] + beyond % per[at] * n}
            kept = [batch.column(x) for x in ("doc_id", "piece", "start", "length", "ids_crc32")]
            kept[1] = kept[1].cast(pa.int32())
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, own.values())], names=["doc_id", "piece", "start", "length", "ids_crc32", *own])

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = cut(rows.mapInArrow(cut_documents(tokenizer or default_tokenizer(), capacity, end_id), PIECES))
    per_task = cut(pieces.groupBy("length", "task").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = pieces.join(first, ["length", "task"]).withColumn("number", F.col("first") + F.col("number")).drop("first", "task")
    return numbered.mapInArrow(place(plan(counts, capacity)), PLACED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
