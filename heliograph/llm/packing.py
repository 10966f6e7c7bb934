"""Harmonic packing of documents into sequences of a fixed number of tokens.

A class k has slots of capacity // k tokens and its sequences take k pieces each, so a piece's sequence
follows from its number within the class alone: workers fill sequences of a class without knowing of each
other's lengths. Classes are 1 to 64 and the powers of two above.

Documents may be cut. Whole sequences come off a long document first; what is left over is cut into at
most four pieces, of which all but the last fill their slots exactly, so that together they leave the
fewest tokens of padding (a table over all lengths below the capacity, made once a worker). Pieces that
a class has beyond its last full sequence are fewer than the classes' slots in total, a fixed number
whatever the input; those are packed together, largest first.

Nulls: a null text is empty, and its one piece is the end id. Rows with a null doc_id and repeated rows
are packed like others. Very long texts are encoded whole. Ways to cut that leave equal padding go to the fewer slots; equal
pieces go by task and row. Columns other than doc_id and text are not read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, table
from .token_ids import default_tokenizer, document_ids

CAPACITY, END_ID = 4096, 2
#: What a further cut costs, in tokens of padding: a cut has to save more.
CUT_COST = 4
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class long, task long, number long"
SEQUENCES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, place long"


def classes(capacity: int) -> list[int]:
    """Slots per sequence, ascending: 1 to 64, then powers of two, up to one slot a token."""
    out = [k for k in range(1, 65) if k <= capacity]
    k = 128
    while k <= capacity:
        out.append(k)
        k *= 2
    return out


@functools.lru_cache(maxsize=4)
def cutting_table(capacity: int, cuts: int = 3) -> tuple[np.ndarray, list[np.ndarray]]:
    """own[r]: class whose slot holds r tokens best; heads[m][r]: with at most m cuts, the class whose whole
    slot is to be cut off first, 0 for none."""
    ks = np.array(classes(capacity))
    slots = capacity // ks
    r = np.arange(capacity + 1)
    at = np.searchsorted(-slots, -r, side="right") - 1  # the last (smallest) slot of at least r
    own = ks[at]
    cost, heads = (slots[at] - r).astype(float), [np.zeros(capacity + 1, dtype=int)]
    cost[0] = 0
    for _ in range(cuts):
        best, head = cost.copy(), np.zeros(capacity + 1, dtype=int)
        for k, slot in zip(ks, slots, strict=True):
            if k > 1:
                new = cost[: capacity + 1 - slot] + CUT_COST
                better = new < best[slot:]
                best[slot:][better], head[slot:][better] = new[better], k
        heads.append(head)
        cost = best
    return own, heads


def cut_lengths(n: int, capacity: int) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a document of n tokens, in order."""
    own, heads = cutting_table(capacity)
    out = [(capacity, 1)] * (n // capacity)
    r = n % capacity
    for m in range(len(heads) - 1, -1, -1):
        if r and (k := int(heads[m][r])):
            out.append((capacity // k, k))
            r -= capacity // k
    return out + [(r, int(own[r]))] * (r > 0)


def cut_documents(tokenizer: str, capacity: int, end_id: int):
    """A function for mapInArrow from (doc_id, text) to PIECES; number counts a class's pieces within the task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), dict.fromkeys(classes(capacity), 0)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids, start = document_ids(tokenizer, text.as_py(), end_id), 0
                for n, k in cut_lengths(len(ids), capacity):
                    rows.append((doc_id, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids), k, task, seen[k]))
                    seen[k] += 1
                    start += n
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 8, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "task", "number"])

    return run


def first_fit(capacity: int):
    """For the one group of left-over pieces, of which there are fewer than all classes' slots: largest first
    into the first sequence with room."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "class", "rank"], ascending=[False, True, True]).reset_index(drop=True)
        room, bins, places = np.zeros(0, dtype=int), [], []
        count: list[int] = []
        for n in rows["length"]:
            fits = np.flatnonzero(room >= n)
            if not len(fits):
                room = np.append(room, capacity)
                count.append(0)
                fits = [len(room) - 1]
            b = int(fits[0])
            room[b] -= n
            bins.append(b)
            places.append(count[b])
            count[b] += 1
        out = rows[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].copy()
        out["sequence_id"], out["place"] = rows["first_free"] + np.array(bins, dtype="int64"), places
        return out

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and sequence_tokens of every piece."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    pieces = cut(rows.mapInArrow(cut_documents(tokenizer or default_tokenizer(), capacity, end_id), PIECES))
    # A worker's first number within a class: what the workers before it have there.
    per_task = pieces.groupBy("class", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("class").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = per_task.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    # At most one row per class from here on.
    lower = Window.orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    full = pieces.groupBy("class").agg(F.floor(F.count("*") / F.col("class")).alias("full"))
    full = full.withColumn("class_first", F.coalesce(F.sum("full").over(lower), F.lit(0))).withColumn("first_free", F.sum("full").over(Window.partitionBy()))
    base = cut(first.join(F.broadcast(full), "class"))
    ranked = pieces.join(base, ["class", "task"]).withColumn("rank", F.col("first") + F.col("number"))
    seq = F.floor(F.col("rank") / F.col("class"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    inner = ranked.filter(seq < F.col("full")).select(*names, (F.col("class_first") + seq).alias("sequence_id"), (F.col("rank") % F.col("class")).alias("place"))
    left_over = ranked.filter(seq >= F.col("full")).select(*names, "class", "rank", "first_free")
    outer = left_over.groupBy("first_free").applyInPandas(first_fit(capacity), SEQUENCES)
    within = Window.partitionBy("sequence_id")
    return (
        inner.unionByName(outer)
        .withColumn("offset", F.sum("length").over(within.orderBy("place")) - F.col("length"))
        .withColumn("sequence_tokens", F.sum("length").over(within))
        .drop("place")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
