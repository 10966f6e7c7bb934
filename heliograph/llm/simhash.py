"""SimHash near-duplicates by covering with anchor points.

A fingerprint has a bit for each bit that is set in over half of its shingles' hashes. Two fingerprints
with at most three differing bits differ in at most one bit of their lower or of their upper half. The
anchors of a half are the words of a code: the perfect Hamming code over its lower 31 bits with the last
bit free. Each half lies within radius 1 of one anchor, its home, and a half one bit away lies within
1 + 1 of that anchor. So every fingerprint goes to its home once and is replicated to all anchors of each
half within covering radius plus threshold, 17 at most, and homes are compared with replicas per anchor.
No pair is missed, and buckets are of 2**27 anchors a half.

Equal fingerprints are one node before that, however many documents have them. An anchor with very many
distinct fingerprints is dealt as pairs of blocks of at most BLOCK rows, and a block pair returns only a
spanning forest of its links, so that such an anchor neither falls to one task nor emits all its pairs.
Components of the links between distinct fingerprints are found within tasks first, then by large-star and small-star rounds.

Nulls: a null or blank text has fingerprint zero and links like any other. A very long text has one fingerprint of all
its shingles. A bit set in exactly half of them is 0. A null doc_id gets its
fingerprint and its component's smallest doc_id, but is never that one. Repeated rows stay. An empty table
gives an empty result. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, cut, join_commonest_apart, table

SHINGLE, SEED, THRESHOLD, BLOCK = 3, 42, 3, 2048
#: An anchor above this many comparisons is dealt in blocks.
MOST_PAIRS = 4_000_000
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def shingle_hashes(text: str | None, words: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle of the text, A-Z in lower case; of the whole sequence if it has fewer words."""
    parts = (text or "").encode("utf-8", "replace").translate(FOLD).split()
    if not parts:
        return np.zeros(0, np.uint64)
    line = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(size + 1) - 1
    spans = zip((ends - size)[: 1 - words or None].tolist(), ends[words - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], seed) for a, b in spans), np.uint64, len(parts) - words + 1)


def majority(hashes: np.ndarray, step: int = 1 << 16) -> int:
    """The fingerprint as an unsigned number."""
    counts = np.zeros(64, np.int64)
    for a in range(0, len(hashes), step):
        counts += np.unpackbits(hashes[a : a + step].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes)).view(np.uint64)[0])


def _fingerprints(words: int, seed: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([majority(shingle_hashes(x.as_py(), words, seed)) for x in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and the fingerprint as a signed long, fp."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprints(words, seed), "doc_id long, fp long")


def _syndrome(y: Column) -> Column:
    """Place 1 to 31 of the bit to flip to reach the Hamming code word of a 31-bit number, 0 if it is one."""
    out = F.lit(0)
    for b in range(5):
        mask = sum(1 << (place - 1) for place in range(1, 32) if place >> b & 1)
        out = out + F.pmod(F.bit_count(y.bitwiseAND(F.lit(mask).cast("long"))), F.lit(2)) * (1 << b)
    return out.cast("int")


def _bit(place: Column) -> Column:
    """1 << (place - 1), 0 for place 0."""
    return F.when(place > 0, F.call_function("shiftleft", F.lit(1).cast("long"), place - 1)).otherwise(F.lit(0).cast("long"))


def replicas(nodes: DataFrame) -> DataFrame:
    """(anchor, fp, home): each fp of nodes at every anchor of its halves within radius 1 plus threshold 1."""
    halves = nodes.select("fp", F.posexplode(F.array(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.call_function("shiftrightunsigned", F.col("fp"), F.lit(32)))).alias("half", "x"))
    parts = halves.select("fp", "half", F.col("x").bitwiseAND(F.lit(0x7FFFFFFF)).alias("y"), F.call_function("shiftright", F.col("x"), F.lit(31)).alias("e"))
    parts = parts.withColumn("s", _syndrome(F.col("y"))).withColumn("code", F.col("y").bitwiseXOR(_bit(F.col("s"))))
    # Code words at distance 2 flip two places whose numbers add up to the syndrome.
    pair = lambda i: F.col("y").bitwiseXOR(_bit(i)).bitwiseXOR(_bit(i.bitwiseXOR(F.col("s"))))
    places = F.filter(F.sequence(F.lit(1), F.lit(31)), lambda i: (F.col("s") > 0) & (i < i.bitwiseXOR(F.col("s"))))
    key = lambda e, code: F.col("half").cast("long") * (1 << 32) + e * (1 << 31) + code
    near = F.concat(F.array(F.struct(key(F.col("e"), F.col("code")).alias("anchor"), F.lit(True).alias("home")), F.struct(key(1 - F.col("e"), F.col("code")).alias("anchor"), F.lit(False).alias("home"))), F.transform(places, lambda i: F.struct(key(F.col("e"), pair(i)).alias("anchor"), F.lit(False).alias("home"))))
    return parts.select("fp", F.explode(near).alias("r")).select("r.anchor", "fp", "r.home")


def spanning(pairs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those pairs that join what is not joined yet."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = x = root.get(root[x], root[x])
        return x

    out = []
    for a, b in pairs:
        if (x := find(a)) != (y := find(b)):
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _block_links(threshold: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        left = rows.loc[rows["home"] & (rows["side"] == 0), "fp"].to_numpy(np.int64)
        right = rows.loc[rows["side"] == 1, "fp"].to_numpy(np.int64)
        found: list[tuple[int, int]] = []
        for a in range(0, len(left), 256):
            i, j = np.nonzero(np.bitwise_count(left[a : a + 256, None].view(np.uint64) ^ right[None].view(np.uint64)) <= threshold)
            found = spanning([*found, *((int(x), int(y)) for x, y in zip(left[a + i], right[j], strict=True) if x != y)])
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def links(nodes: DataFrame, threshold: int = THRESHOLD, block: int = BLOCK, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """(a, b) with a < b: links of at most threshold (3 or fewer) differing bits between the distinct fp of
    nodes; of an anchor with over most_pairs comparisons only a spanning forest of them."""
    if not 0 <= threshold <= 3:
        raise ValueError("halves within one bit cover at most 3 differing bits")
    at = replicas(nodes)
    crowded = at.groupBy("anchor").agg(F.count_if("home").alias("homes"), F.count("*").alias("n")).filter((F.col("homes") > 0) & (F.col("homes") * F.col("n") > most_pairs))
    crowded = cut(crowded.select("anchor", F.ceil(F.col("n") / block).alias("blocks")))
    far = F.bit_count(F.col("h.fp").bitwiseXOR(F.col("r.fp")))
    hot = crowded.limit(1).count() > 0
    calm = at.join(crowded, "anchor", "left_anti") if hot else at
    homes, rest = calm.filter("home").select("anchor", "fp").alias("h"), calm.select("anchor", "fp").alias("r")
    found = homes.join(rest, (F.col("h.anchor") == F.col("r.anchor")) & (F.col("h.fp") < F.col("r.fp")) & (far <= threshold)).select(F.col("h.fp").alias("a"), F.col("r.fp").alias("b"))
    if hot:
        own = at.join(crowded, "anchor").withColumn("block", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")))
        other = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
        sides = F.concat(F.transform(other, lambda i: F.struct(F.col("block").alias("i"), i.alias("j"), F.lit(0).alias("side"))), F.transform(other, lambda i: F.struct(i.alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"))))
        dealt = own.select("anchor", "fp", "home", F.explode(sides).alias("p")).select("anchor", "fp", "home", "p.*").filter(F.col("home") | (F.col("side") == 1))
        forest = dealt.groupBy("anchor", "i", "j").applyInPandas(_block_links(threshold), "a long, b long")
        found = found.unionByName(forest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    return found.distinct()


#: Edges that one task joins by itself before tasks exchange any.
LOCAL = 500_000


def _stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a task's edges (u, v) to (u, v) with v the least that u reaches by these edges alone."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.setdefault(x, x)) != x:
            root[x] = x = root[y]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
    every = [(u, find(u)) for u in root]
    u, v = zip(*((u, v) for u, v in every if u != v), strict=True) if len(every) > 1 else ((), ())
    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def components(edges: DataFrame, rounds: int = 50, local: int = LOCAL) -> DataFrame:
    """(node, root): every node of edges (a, b) with the smallest node it can reach. Tasks first join the edges they have, `local`
    each; if there are several, alternating large-star and small-star rounds follow until nothing changes, each two shuffles of at
    most the edges' size."""
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    tasks = max(1, -(-edges.count() // local))
    dealt = edges.coalesce(tasks) if tasks <= edges.rdd.getNumPartitions() else edges.repartition(tasks)
    edges = cut(dealt.mapInArrow(_stars, "u long, v long"))
    digest = [F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")]
    before = edges.agg(*digest).first() if tasks > 1 else None
    for _ in range(rounds):
        if tasks == 1 or before["n"] == 0:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        edges = cut(small)
        after = edges.agg(*digest).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, words: int = SHINGLE, seed: int = SEED, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits) and component_id, the smallest doc_id reachable over
    links of at most threshold differing bits."""
    prints = cut(fingerprints(docs, words, seed))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("times")))
    roots = components(links(nodes.select("fp"), threshold)).withColumnRenamed("node", "fp")
    named = nodes.drop("times")
    rooted = cut(named.join(roots, "fp").union(named.join(roots.select(F.col("root").alias("fp")).distinct(), "fp").select("fp", "first_id", F.col("fp").alias("root"))))
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_linked = rooted.join(ids, "root").select("fp", "component_id")
    of_node = cut(nodes.join(of_linked, "fp", "left").select("fp", "times", F.coalesce("component_id", "first_id").alias("component_id")))
    # Blank texts and boilerplate may have one fingerprint a third of all rows.
    return join_commonest_apart(prints, of_node, "fp", "times").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
