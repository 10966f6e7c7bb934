"""Near-duplicate texts by word shingles: groups of documents whose shingle sets have a Jaccard similarity of
at least a threshold. No link between different texts is missed.

SimHash fingerprints come first (operator simhash): those within three bits are found at anchors of a covering code,
and their texts are held to the exact similarity. This joins most copies, but at a similarity of 0.8 about ten of 64 bits
differ, so a second filter follows that is complete. Shingles have one order for all texts, and a text's keys are
its first n - ceil(similarity n) + 1 of n shingles: two texts of at least the similarity have a key in common.
The order is by how common a shingle is (its number in every SAMPLED-th text, of the COMMON most frequent ones), then by hash.
Any order finds the same links; this one keeps passages that many texts share out of the keys.

Members of a key are compared only where they are not in one group yet. First each meets one leader of its key, ROUNDS
times at most, while that promises to save work. All pairs of different groups that are left are then compared: keys of few such
pairs list them, and those of many are dealt as pairs of blocks of about ELEMENTS shingles, compared within a task, which
returns a spanning forest. Neither a crowded key nor a hot group of copies falls to one task. Equal sets are one node, and keys
with the same members count once. A listed pair is first held to a bound by its keys alone: what two sets can share beyond the
lesser of their last keys is at most the lesser rest. Whole sets are made only for pairs that pass.

Nulls: a row with a null doc_id is kept and not compared. A null text is empty, and texts without words are
copies of each other. Rows of one doc_id with different texts are judged each by its own text; equal rows are copies. An empty
table gives an empty result.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .mixing import small
from .shared import cut

WORDS, SIMILARITY = 5, 0.8
#: Common shingles are counted in one text of so many, and are those with at least LEAST_COMMON there, COMMON at most.
SAMPLED, LEAST_COMMON, COMMON = 16, 2, 200_000
#: Leader rounds, at most; they end when the pairs left are fewer than PAIRS_A_ROW for each row, or over half of those before.
ROUNDS, PAIRS_A_ROW = 5, 4
#: A key of more pairs than this is dealt in blocks of about ELEMENTS shingles.
LISTED, ELEMENTS = 4096, 100_000
PRINTS = "doc_id long, t long, node long, n long, fp long, keys array<long>"
ODD = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    for by in (0xD6E8FEB86659FD93, 0xD6E8FEB86659FD93):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(by)
    return x ^ (x >> np.uint64(32))


@functools.lru_cache(maxsize=1)
def _bytes() -> np.ndarray:
    """A 64-bit number for each byte."""
    return mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(ODD))


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64)] * 2


def _powers(n: int) -> list[np.ndarray]:
    """ODD**i and its inverse mod 2**64 for i below n at least."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((ODD, pow(ODD, -1, 1 << 64))):
            every = np.full(max(n, 1 << 16), base, np.uint64)
            every[0] = 1
            _POWERS[k] = np.cumprod(every)
    return _POWERS


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """A 64-bit hash of every shingle of the text, A-Z in lower case, words joined by one space; of the whole sequence if it
    has fewer words. Hashes are differences of running sums over the bytes, so all of a text's come at once."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace").translate(simhash.FOLD), np.uint8)
    space = _SPACE[raw]
    first = np.ones(len(raw), bool)
    first[1:] = space[:-1]
    keep = ~space | ~first  # of a run of white space the first sign stays
    line, gap = raw[keep], space[keep]
    if len(line) and gap[-1]:
        line, gap = line[:-1], gap[:-1]
    if not len(line):
        return np.zeros(0, np.uint64)
    starts = np.concatenate([[0], np.flatnonzero(gap) + 1])
    ends = np.concatenate([starts[1:] - 1, [len(line)]])
    forth, back = _powers(len(line) + 1)
    sums = np.zeros(len(line) + 1, np.uint64)
    np.cumsum(np.where(gap, _bytes()[32], _bytes()[line]) * forth[: len(line)], out=sums[1:])
    a, b = (starts[:1], ends[-1:]) if len(starts) <= words else (starts[: 1 - words or None], ends[words - 1 :])
    return mixed((sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    return np.unique(shingle_hashes(text, words))


#: Bits of a key below its shingle's grade.
LOW = 58


def grades_of(own: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How common each shingle of a set is: 0, or what common (sorted shingles, grades 1 to 31) says."""
    if not len(common[0]):
        return np.zeros(len(own), np.uint64)
    at = np.minimum(np.searchsorted(common[0], own), len(common[0]) - 1)
    return np.where(common[0][at] == own, common[1][at], np.uint64(0))


NONE = np.zeros(0, np.uint64), np.zeros(0, np.uint64)


def keys_of(own: np.ndarray, similarity: float = SIMILARITY, common: tuple[np.ndarray, np.ndarray] = NONE) -> np.ndarray:
    """The first shingles of a set in the order of all texts, ascending: grade and the upper bits of the hash."""
    if not len(own):
        return own
    ranks = np.sort((grades_of(own, common) << np.uint64(LOW)) | (own >> np.uint64(64 - LOW)))
    return ranks[: len(own) - math.ceil(similarity * len(own) - 1e-9) + 1]


def _signed(x: Iterable[int] | np.ndarray) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _prints(words: int, similarity: float, common):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, n, fps, keys = [], [], [], []
            for text in batch.column("text"):
                every = shingle_hashes(text.as_py(), words)
                own = np.unique(every)
                nodes.append(xxhash.xxh64_intdigest(own.tobytes()))
                n.append(len(own))
                fps.append(simhash.majority(every))
                keys.append(_signed(keys_of(own, similarity, common.value)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), pa.array(_signed(nodes)), pa.array(n, pa.int64()), pa.array(_signed(fps)), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "t", "node", "n", "fp", "keys"])

    return run


def _sets(words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x.as_py(), words) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(_signed([xxhash.xxh64_intdigest(x.tobytes()) for x in sets])), pa.array([_signed(x) for x in sets], pa.list_(pa.int64()))], names=["node", "hashes"])

    return run


SETS = "node long, hashes array<long>"


def few(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """df written out, in as many partitions as its rows need."""
    df = cut(df)
    return df.coalesce(max(1, -(-df.count() // rows)))


def common_shingles(docs: DataFrame, words: int = WORDS, sampled: int = SAMPLED, least: int = LEAST_COMMON, most: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """The shingles, sorted, that come late in the order of keys, `most` at most, and their grades: 1 + log2 of their number."""
    some = docs.filter(F.pmod(F.xxhash64("text"), F.lit(sampled)) == 0).groupBy("t").agg(F.min("text").alias("text")).mapInArrow(_sets(words), SETS)
    counts = some.select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    rows = counts.orderBy(F.desc("n"), "h").limit(most).select("h", F.least(F.floor(F.log2("n")) + 1, F.lit(31)).cast("int").alias("g")).toPandas()
    hashes, grades = rows["h"].to_numpy(np.int64).view(np.uint64), rows["g"].to_numpy(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], grades[order]


def _block_links(similarity: float):
    """For applyInPandas over the members of two blocks (side 0 or 1): pairs of different groups that are similar, as many as
    join what they join. Shared counts are products of 0/1 tiles over the shingles that more than one member has."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sides = [rows[(rows["side"] == s).to_numpy()] for s in (0, 1)]
        sizes = [x["n"].to_numpy() for x in sides]
        values = [np.concatenate([*x["hashes"], np.zeros(0, np.int64)]) for x in sides]
        owners = [np.repeat(np.arange(len(x)), n) for x, n in zip(sides, sizes, strict=True)]
        shared = np.intersect1d(*values)
        both = np.zeros((len(sides[0]), len(sides[1])), np.float32)
        for a in range(0, len(shared), 4096):
            part = shared[a : a + 4096]
            tiles = []
            for x, v, o in zip(sides, values, owners, strict=True):
                at = np.minimum(np.searchsorted(part, v), len(part) - 1)
                hit = part[at] == v
                tile = np.zeros((len(x), len(part)), np.float32)
                tile[o[hit], at[hit]] = 1
                tiles.append(tile)
            both += tiles[0] @ tiles[1].T
        every = sizes[0][:, None] + sizes[1][None] - both
        groups = [x["group"].to_numpy() for x in sides]
        i, j = np.nonzero((both >= similarity * every - 1e-6) & (groups[0][:, None] != groups[1][None]))
        of = {tuple(map(int, g)): p for p, g in zip(zip(i, j, strict=True), zip(groups[0][i], groups[1][j], strict=True), strict=True)}
        links = [of[g] for g in simhash.spanning(of)]
        one, two = sides[0]["node"].to_numpy(), sides[1]["node"].to_numpy()
        return pd.DataFrame([(one[p], two[q]) for p, q in links], columns=["a", "b"], dtype="int64")

    return run


def node_roots(known: DataFrame, nodes: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, rounds: int = ROUNDS, listed: int = LISTED, elements: int = ELEMENTS) -> DataFrame:
    """(node, root) of the nodes that are linked with any other."""
    fits = F.least("n", "m") >= similarity * F.greatest("n", "m") - 1e-9
    ordered = lambda: [F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b")]

    every = nodes.select("node", "n", F.explode("keys").alias("key"))
    held = every.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1").select("key")
    left = few(every.join(held, "key"))
    # Keys with the same members count once.
    marks = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in (1, 2)]
    once = left.groupBy("key").agg(F.count("*").alias("members"), *marks).groupBy("members", "x1", "x2").agg(F.min("key").alias("key")).select("key")
    left = few(left.join(once, "key"))

    first = cut(nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("f")).select("fp", F.col("f.node").alias("lead"), F.col("f.n").alias("m")))
    near = simhash.links(first.select("fp"), most_pairs=200_000, block=1024)
    of_print = nodes.join(first, "fp").filter("node <> lead").select("lead", "m", "node", "n")
    of_near = near.join(first.withColumnRenamed("fp", "a"), "a").join(first.select(F.col("fp").alias("b"), F.col("lead").alias("node"), F.col("m").alias("n")), "b").select("lead", "m", "node", "n")
    pairs = few(of_print.unionByName(of_near).filter(fits).select(*ordered()).distinct())

    def sets_of(some: DataFrame) -> DataFrame:
        """The whole sets of the nodes in some, whose texts are read again; rows of an equal id and text repeat theirs."""
        rows = few(nodes.join(small(some, 200_000), "node", "left_semi").select("doc_id", "t"))
        return few(known.join(small(rows, 100_000), ["doc_id", "t"], "left_semi").select("text").mapInArrow(_sets(words), SETS), 5_000)

    def similar(pairs: DataFrame) -> DataFrame:
        """Those pairs (a, b) that have the similarity: first by what their keys leave possible, then by their sets."""
        asked = few(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        of_pairs = nodes.join(small(asked, 200_000), "node", "left_semi")
        one = of_pairs.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("keys").alias("x"))
        two = of_pairs.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("keys").alias("y"))
        last = F.least(F.element_at("x", -1), F.element_at("y", -1))
        rest = lambda n, keys: F.col(n) - F.size(F.filter(keys, lambda k: k <= F.col("last")))
        bound = F.size(F.array_intersect("x", "y")) + F.least(rest("na", "x"), rest("nb", "y"))
        possible = pairs.join(one, "a").join(two, "b").withColumn("last", last).filter(bound * (1 + similarity) >= similarity * (F.col("na") + F.col("nb")) - 1e-6)
        possible = few(possible.select("a", "b"))
        sets = sets_of(few(possible.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
        one = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
        two = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        return possible.join(one, "a").join(two, "b").filter(both >= similarity * (F.size("x") + F.size("y") - both) - 1e-9).select("a", "b")

    def unsettled(found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of keys with members of several groups, with their group; and each such key's pairs of different groups."""
        of = simhash.components(found)
        rows = left.join(of, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("group"))
        sizes = rows.groupBy("key", "group").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("members"), F.sum(F.col("c") * F.col("c")).alias("within"), F.count("*").alias("groups"))
        sizes = sizes.filter("groups > 1").select("key", ((F.col("members") * F.col("members") - F.col("within")) / 2).cast("long").alias("pairs"))
        rows = few(rows.join(sizes, "key"))
        return rows, rows.groupBy("key").agg(F.first("pairs").alias("pairs"))

    found = few(similar(pairs))
    rows, sizes = unsettled(found)
    before = math.inf
    for i in range(rounds):
        n, work = rows.agg(F.count("*")).first()[0], sizes.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]
        if work <= PAIRS_A_ROW * n or work > before / 2:
            break
        before = work
        # A few leaders for all keys, so that most keys of two texts ask for the same pair.
        least = F.min(F.struct(F.xxhash64("node", F.lit(i), F.pmod("key", F.lit(4))).alias("h"), "node", "n", "group"))
        lead = rows.groupBy("key").agg(least.alias("l")).select("key", F.col("l.node").alias("lead"), F.col("l.n").alias("m"), F.col("l.group").alias("lead_group"))
        asked = rows.join(lead, "key").filter(fits & (F.col("group") != F.col("lead_group"))).select(*ordered()).distinct()
        found = few(found.unionByName(similar(few(asked))))
        rows, sizes = unsettled(found)

    other = rows.select("key", F.col("node").alias("lead"), F.col("n").alias("m"), F.col("group").alias("lead_group"))
    asked = rows.filter(F.col("pairs") <= listed).join(other, "key").filter(fits & (F.col("group") < F.col("lead_group"))).select(*ordered()).distinct()
    found = found.unionByName(similar(few(asked)))
    many = rows.filter(F.col("pairs") > listed)
    if many.limit(1).count():
        blocks = many.groupBy("key").agg(F.ceil(F.sum("n") / elements).cast("int").alias("blocks"))
        own = many.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int")).join(sets_of(few(many.select("node").distinct())), "node")
        both = F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.array(F.struct(F.col("own").alias("i"), o.alias("j"), F.lit(0).alias("side")), F.struct(o.alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"))))), lambda p: p["i"] <= p["j"])
        dealt = own.select("key", "node", "n", "group", "hashes", F.explode(both).alias("p")).select("key", "node", "n", "group", "hashes", "p.*")
        found = found.unionByName(dealt.groupBy("key", "i", "j").applyInPandas(_block_links(similarity), "a long, b long"))
    return simhash.components(found)


def groups(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, t (hash of the text), kept_id and kept_t of each row with a doc_id: the row of its group that stays, of least doc_id."""
    known = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(known, words))
    prints = cut(known.mapInArrow(_prints(words, similarity, common), PRINTS))
    least = F.min(F.struct("doc_id", "t"))
    nodes = cut(prints.groupBy("node").agg(least.alias("d"), *(F.first(c).alias(c) for c in ("n", "fp", "keys"))).select("node", "d.*", "n", "fp", "keys"))
    roots = node_roots(known, nodes, words, similarity)
    rooted = nodes.join(roots, "node", "left").select("node", "doc_id", "t", F.coalesce("root", "node").alias("root"))
    kept = rooted.groupBy("root").agg(least.alias("k")).select("root", F.col("k.doc_id").alias("kept_id"), F.col("k.t").alias("kept_t"))
    of_node = cut(rooted.join(kept, "root").select("node", "kept_id", "kept_t"))
    return prints.select("doc_id", "t", "node").join(of_node, "node").select("doc_id", "t", "kept_id", "kept_t")


def superfluous(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, t, kept_id) of the rows that are similar to one kept."""
    return groups(docs, words, similarity).filter((F.col("doc_id") != F.col("kept_id")) | (F.col("t") != F.col("kept_t"))).select("doc_id", "t", "kept_id").distinct()


def keep_one(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group of similar ones, that of least doc_id."""
    rows = cut(groups(docs, words, similarity))
    gone = cut(rows.filter((F.col("doc_id") != F.col("kept_id")) | (F.col("t") != F.col("kept_t"))).select("doc_id", "t").distinct())
    again = cut(rows.groupBy("doc_id", "t").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "t"))
    held = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"))
    left = held.join(small(gone, 200_000), ["doc_id", "t"], "left_anti")
    if again.limit(1).count():
        repeated = small(again, 200_000)
        one = left.join(repeated, ["doc_id", "t"], "left_semi").dropDuplicates(["doc_id", "t"])
        left = left.join(repeated, ["doc_id", "t"], "left_anti").unionByName(one)
    return left.select("row.*")
