"""Nearest vectors by a block matrix join.

Queries and candidates are packed into blocks of rows and every block of queries meets every block of
candidates once: a stated set of queries against all rows. In a task, both blocks are quantised to int8 on
one scale and one matrix product gives all their approximate distances. A vector's own quantisation error
is known exactly, so the true distance lies within the sum of the two errors; what cannot be among the
query's k nearest of the block by that bound is dropped, and what is left is computed again from the
original vectors in double precision. Each block pair returns at most k rows a query, and these heaps are
merged by rank. The result is exact, whatever the quantisation.

Vectors that are null, empty, zero or hold null or non-finite components take no part, as query or as
candidate. Vectors of other lengths than a query's are not compared with it. Ties go to the smaller
vec_id. All rows of the query's own vec_id are its own; repeated rows of another vec_id count each. Fewer
candidates than k give fewer rows; an empty table none. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table

#: Every candidate goes once to each block of queries, so those are large: of so many bytes.
K, QUERY_BYTES, CANDIDATE_ROWS = 10, 32 << 20, 8192
BLOCK = "dim int, ids binary, vectors binary"
HEAP = "query_id long, vec_id long, score double"


def pack_blocks(rows_per_block: int):
    """For mapInArrow from (vec_id, v) of good vectors to blocks of one dimension: ids as int64 and vectors as doubles."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, vectors = zip(*held.pop(dim), strict=True)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([np.array(vectors, "<f8").tobytes()], pa.binary())], names=["dim", "ids", "vectors"])

        for b in batches:
            for i, v in zip(b.column("vec_id").to_pylist(), b.column("v"), strict=True):
                x = v.values.to_numpy(zero_copy_only=False)
                held.setdefault(len(x), []).append((i, x))
                if len(held[len(x)]) >= rows_per_block:
                    yield block(len(x))
        for dim in [*held]:
            yield block(dim)

    return run


def exact_distances(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Euclidean distance of rows q[i] and c[i], summed component by component in order."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += (q[:, d] - c[:, d]) ** 2
    return np.sqrt(out)


def quantised(x: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """int8 components, and the exact length of what rounding took from each row."""
    tile = np.rint(x / scale).astype(np.int8)
    return tile, np.sqrt(((x - tile * scale) ** 2).sum(1))


def nearest_in_block(qids: np.ndarray, q: np.ndarray, cids: np.ndarray, c: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score) of each query's k nearest candidates of the block."""
    scale = max(np.abs(q).max(), np.abs(c).max()) / 127
    if scale == 0 or not np.isfinite(scale):
        scale = 1.0
    qt, qe = quantised(q, scale)
    ct, ce = quantised(c, scale)
    kind = np.float32 if q.shape[1] <= 1000 else np.float64  # sums of int8 products are whole numbers that it holds exactly
    a, b = qt.astype(kind), ct.astype(kind)
    square = (a.astype(np.float64) ** 2).sum(1)[:, None] + (b.astype(np.float64) ** 2).sum(1)[None] - 2.0 * (a @ b.T)
    near = np.sqrt(np.maximum(square, 0)) * scale
    slack = (qe[:, None] + ce[None]) * (1 + 1e-9) + near * 1e-9
    own = qids[:, None] == cids[None]
    high = np.where(own, np.inf, near + slack)
    most = np.partition(high, min(k, len(cids)) - 1, axis=1)[:, min(k, len(cids)) - 1]
    rows, cols = np.nonzero((near - slack <= most[:, None]) & ~own)
    score = np.empty(len(rows))
    for at in range(0, len(rows), 1 << 16):
        score[at : at + (1 << 16)] = exact_distances(q[rows[at : at + (1 << 16)]], c[cols[at : at + (1 << 16)]])
    order = np.lexsort((cids[cols], score, rows))
    rows, cols, score = rows[order], cols[order], score[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
    keep = place < k
    return qids[rows[keep]], cids[cols[keep]], score[keep]


def _join_blocks(k: int):
    """For mapInArrow from pairs of blocks to HEAP; candidates are taken in tiles that bound memory."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                dim = r["dim"]
                ids = lambda x: np.frombuffer(x, "<i8")
                vectors = lambda x, dim=dim: np.frombuffer(x, "<f8").reshape(-1, dim)
                qids, q = ids(r["qids"]), vectors(r["qvectors"])
                cids, c = ids(r["ids"]), vectors(r["vectors"])
                for a in range(0, len(qids), 256):
                    one, two, three = nearest_in_block(qids[a : a + 256], q[a : a + 256], cids, c, k)
                    yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(three)], names=["query_id", "vec_id", "score"])

    return run


def good_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): vectors of finite doubles that are not all zero."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = F.col("v")
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, fine) & F.exists(v, lambda x: x != 0))


def search(queries: DataFrame, rows: DataFrame, k: int = K, query_rows: int | None = None, candidate_rows: int = CANDIDATE_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of the k rows nearest to each query; both have (vec_id, v) from good_vectors."""
    spark = rows.sparkSession
    fit = max(1, spark.sparkContext.defaultParallelism)
    size = queries.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("dim")).first()
    query_rows = query_rows or max(1024, QUERY_BYTES // (8 * size["dim"]))
    blocks = max(1, -(-size["n"] // query_rows))
    packed = queries.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).repartition(blocks, "b").select("vec_id", "v").mapInArrow(pack_blocks(query_rows), BLOCK)
    # A query block for each number below its count; candidate blocks are copied to these numbers.
    asked = packed.select("dim", F.col("ids").alias("qids"), F.col("vectors").alias("qvectors")).withColumn("to", F.pmod(F.xxhash64("qids"), F.lit(blocks)))
    given = rows.mapInArrow(pack_blocks(candidate_rows), BLOCK).withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(fit)))
    spread = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(fit - 1))))
    heaps = given.join(spread, ["dim", "to", "salt"]).select("dim", "qids", "qvectors", "ids", "vectors").mapInArrow(_join_blocks(k), HEAP)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return heaps.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = good_vectors(table(spark, sf_dir, "embeddings"))
    return search(rows.filter(F.col("vec_id") % 100 == 0), rows)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, 
    sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
