"""Place names in posts: one place a name, matching with and without spaces between words, and what follows."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from heliograph.functions import UNSPACED, usable_name
from heliograph.shared import checkpointed

#: A name of several kinds of places means the first of these.
KINDS = ("country", "city", "adm1")


def place_names(places: DataFrame) -> DataFrame:
    """(place_id, name) of a gazetteer's first and alternate names, each once; places has alternates, a comma list."""
    every = F.concat(F.array("name"), F.filter(F.split(F.coalesce("alternates", F.lit("")), ","), lambda x: x != ""))
    return places.select(F.col("id").alias("place_id"), F.explode(F.array_distinct(every)).alias("name")).dropDuplicates(["place_id", "name"])


def usable_names(places: DataFrame) -> DataFrame:
    """(place_id, name, kind, population) of the names that may be looked for in posts."""
    every = place_names(places).join(places.select(F.col("id").alias("place_id"), F.col("name").alias("first"), "kind", "population"), "place_id")
    return every.filter(usable_name(F.col("name"), F.col("name") == F.col("first"))).drop("first")


def with_country(places: DataFrame, codes: DataFrame) -> DataFrame:
    """fips of a place's country, and its division's code."""
    known = F.broadcast(codes.select("iso2", "fips"))
    return places.join(known, "iso2", "left").withColumn("division", F.concat("fips", "admin1"))


def weighted_centroid(cities: DataFrame, by: str) -> DataFrame:
    w = F.greatest("population", F.lit(1))
    return cities.groupBy(by).agg((F.sum(F.col("lon") * w) / F.sum(w)).alias("lon"), (F.sum(F.col("lat") * w) / F.sum(w)).alias("lat"))


def one_place_per_name(names: DataFrame) -> DataFrame:
    """Each name's place: countries before cities before divisions, then the most people, then the least id."""
    rank = F.coalesce(*(F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(KINDS)), F.lit(len(KINDS)))
    return names.withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy(rank, F.desc("population"), "place_id"))).filter("_n = 1").drop("_n")


#: Letters and digits, as `apart` knows them.
RUN = re.compile("[^\\W_]+")


def name_parts(names: DataFrame) -> DataFrame:
    """(place_id, name, body, tail, runs, signs): a name's body up to its last run of letters and digits and what follows it;
    how many runs it has, and, of a name in an unspaced script, how many signs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for k, (name, loose) in enumerate(zip(batch.column("name").to_pylist(), batch.column("loose").to_pylist(), strict=True)):
                ends = [m.end() for m in RUN.finditer(name)]
                if loose or ends:
                    at.append(k)
                    out.append((name, "", 0, len(name)) if loose else (name[: ends[-1]], name[ends[-1] :], len(ends), 0))
            own = batch.select(["place_id", "name"]).take(pa.array(at, pa.int64()))
            made = [pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*own.columns, *made], names=["place_id", "name", "body", "tail", "runs", "signs"])

    given = names.filter("name <> ''").select("place_id", "name", F.col("name").rlike(f"^[{UNSPACED}]").alias("loose"))
    kinds = [StructField("body", StringType()), StructField("tail", StringType()), StructField("runs", IntegerType()), StructField("signs", IntegerType())]
    return given.mapInArrow(run, StructType([names.schema["place_id"], names.schema["name"], *kinds]))


#: Bits that tell which n-grams may be names, and how many of them one row brings to the driver.
BITS, PIECE = 1 << 26, 1 << 16


#: Texts whose matches a task holds at a time.
AT_ONCE = 256


def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(k, AT_ONCE)


def name_bits(bodies: DataFrame) -> bytes:
    """A bit for each remainder of a CRC-32 that some body has; as many bytes for any number of names."""

    def piece(table: pa.Table) -> pa.Table:
        on = np.zeros(PIECE, np.uint8)
        on[table.column("bit").to_numpy()] = 1
        return pa.table({"piece": table.column("piece").slice(0, 1), "bits": pa.array([np.packbits(on, bitorder="little").tobytes()])})

    h = F.pmod(F.crc32(F.col("body").cast("binary")), F.lit(BITS))
    placed = bodies.select(F.floor(h / PIECE).cast("int").alias("piece"), (h % PIECE).cast("int").alias("bit")).distinct()
    out = bytearray(BITS // 8)
    for r in placed.groupBy("piece").applyInArrow(piece, "piece int, bits binary").collect():  # at most BITS / PIECE of 8 KB
        out[r["piece"] * PIECE // 8 : (r["piece"] + 1) * PIECE // 8] = r["bits"]
    return bytes(out)


def grams(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """(id, body, start, end, after) of a text's n-grams that may be bodies of `name_parts`: n runs with what lies between them, and n
    signs from one on that begins a name in an unspaced script. Starts and ends count signs; after is what follows up to the next run,
    one sign longer than the longest tail at most, with a space at the end of the text. Which n-grams may be bodies is told by
    `name_bits`, so that few others leave the task."""
    sizes = parts.groupBy("runs", "signs", F.substring("body", 1, 1).alias("sign")).agg(F.max(F.length("tail")).alias("tail")).collect()  # lengths and first signs
    runs, signs = (sorted({r[c] for r in sizes} - {0}) for c in ("runs", "signs"))
    firsts, loose = ({r["sign"] for r in sizes if (r["signs"] > 0) == x} for x in (False, True))
    begins = re.compile("[" + "".join(map(re.escape, sorted(loose))) + "]") if loose else None
    most = 1 + max((r["tail"] for r in sizes), default=0)
    shared = texts.sparkSession.sparkContext.broadcast(name_bits(parts))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, last = shared.value, BITS // 8 - 1
        for batch in pieces(batches):
            rows = []
            add = rows.append
            for k, value in enumerate(batch.column("text")):
                text = value.as_py() or ""
                spans = [m.span() for m in RUN.finditer(text)] if firsts else []
                for i, (start, _) in enumerate(spans):
                    if text[start] in firsts:
                        for n in runs:
                            if i + n > len(spans):
                                break
                            end = spans[i + n - 1][1]
                            h = crc32((body := text[start:end]).encode())
                            if bits[h >> 3 & last] >> (h & 7) & 1:
                                free = spans[i + n][0] if i + n < len(spans) else len(text)
                                add((k, body, start, end - 1, text[end : min(free, end + most)] + ("" if free < len(text) else " ")))
                for m in begins.finditer(text) if begins else ():
                    start = m.start()
                    for n in signs:
                        if start + n > len(text):
                            break
                        h = crc32((body := text[start : start + n]).encode())
                        if bits[h >> 3 & last] >> (h & 7) & 1:
                            add((k, body, start, start + n - 1, " "))
            at, *rest = zip(*rows, strict=True) if rows else [()] * 5
            made = [pa.array(c, kind) for c, kind in zip(rest, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int64())), *made], names=["id", "body", "start", "end", "after"])

    kinds = [StructField("body", StringType()), StructField("start", LongType()), StructField("end", LongType()), StructField("after", StringType())]
    return texts.select("id", F.col("text").cast("string").alias("text")).mapInArrow(run, StructType([texts.schema["id"], *kinds]))


#: How names begin: with a capital, or in a script without.
FIRST = "^[\\p{L}&&[^\\p{Ll}]]"
#: Most names, and most signs of them together, for which every worker holds an automaton; more are matched by n-grams. Names
#: at random up to both take 170 MB of a worker, and 310 MB while they load.
MOST_NAMES, MOST_SIGNS = 250_000, 4_000_000


def match_names(texts: DataFrame, names: DataFrame, first: str = FIRST, most_names: int = MOST_NAMES, most_signs: int = MOST_SIGNS) -> DataFrame:
    """(id, place_id, start): names as written in texts. A name in a script with spaces between words stands between signs that are no
    letters or digits; of overlapping matches the leftmost holds, of those the longest. `start` orders the matches of a text. Names
    begin as the pattern `first` says. names has one place a name (of several, the least counts).

    Names within both bounds are looked for by one automaton, in one pass over each text; no text is shuffled. More names than that
    meet the texts' n-grams by a join."""
    good = names.filter(F.col("name").rlike(first) | F.col("name").rlike(f"^[{UNSPACED}]")).filter("name <> ''")
    rows = good.select("name", "place_id", F.col("name").rlike(f"^[{UNSPACED}]").alias("loose")).limit(most_names + 1).collect()
    if len(rows) > most_names or sum(len(r["name"]) for r in rows) > most_signs:
        return match_by_grams(texts, names, first)
    return match_by_automaton(texts, [tuple(r) for r in rows])


def name_automaton(rows: Iterable[tuple[str, int, bool]]):
    """An automaton over (name, place_id, loose) rows; None for none."""
    import ahocorasick

    least: dict[str, tuple[int, int, bool]] = {}
    for name, place, loose in rows:
        if name not in least or place < least[name][1]:
            least[name] = (len(name), place, loose)
    if not least:
        return None
    out = ahocorasick.Automaton()
    for name, value in least.items():
        out.add_word(name, value)
    out.make_automaton()
    return out


def apart(text: str, at: int) -> bool:
    """Whether no letter or digit is there."""
    return not 0 <= at < len(text) or unicodedata.category(text[at])[0] not in "LN"


def named_in(automaton, text: str) -> list[tuple[int, int]]:
    """(start, place_id) of the names that hold, in order."""
    hits = []
    for end, (n, place, loose) in automaton.iter(text):
        start = end - n + 1
        if loose or (apart(text, start - 1) and apart(text, end + 1)):
            hits.append((start, -end, place))
    out, free = [], -1
    for start, less, place in sorted(hits):
        if start > free:
            out.append((start, place))
            free = -less
    return out


def match_by_automaton(texts: DataFrame, rows: list[tuple[str, int, bool]]) -> DataFrame:
    """`match_names` by an automaton over (name, place_id, loose) rows, built once and sent to every worker once."""
    spark, given = texts.sparkSession, texts.select("id", F.col("text").cast("string").alias("text"))
    schema = StructType([texts.schema["id"], StructField("place_id", LongType()), StructField("start", LongType())])
    automaton = name_automaton(rows)
    if automaton is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(automaton)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            at, starts, places = [], [], []
            for k, text in enumerate(batch.column("text")):
                for start, place in named_in(shared.value, text.as_py() or ""):
                    at.append(k)
                    starts.append(start)
                    places.append(place)
            ids = batch.column("id").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(places, pa.int64()), pa.array(starts, pa.int64())], names=["id", "place_id", "start"])

    return given.mapInArrow(run, schema)


def match_by_grams(texts: DataFrame, names: DataFrame, first: str = FIRST) -> DataFrame:
    """`match_names` by an equality on n-grams, for any number of names."""
    good = names.filter(F.col("name").rlike(first) | F.col("name").rlike(f"^[{UNSPACED}]"))
    parts = checkpointed(name_parts(good).select("body", "tail", "place_id", "runs", "signs"))
    hits = grams(texts, parts).join(parts.select("body", "tail", "place_id"), "body")
    # What follows a name's tail is no letter or digit: the part after its last run goes on, or the text ends (a space stands for that).
    whole = F.col("after").startswith(F.col("tail")) & (F.length("after") > F.length("tail"))
    return leftmost(hits.filter(whole).select("id", "place_id", "start", (F.col("end") + F.length("tail")).alias("end")))


def leftmost(hits: DataFrame) -> DataFrame:
    """Of the overlapping matches of a text the leftmost, of those the longest, of those the least place: (id, place_id, start)."""
    ordered = hits.repartition("id").sortWithinPartitions("id", "start", F.desc("end"), "place_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, free = None, -1
        for batch in batches:
            keep = []
            for k, (own, start, end) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("id", "start", "end")), strict=True)):
                if own != text:
                    text, free = own, -1
                if start > free:
                    keep.append(k)
                    free = end
            yield batch.select(["id", "place_id", "start"]).take(pa.array(keep, pa.int64()))

    return ordered.mapInArrow(run, StructType([hits.schema[c] for c in ("id", "place_id", "start")]))


def stop_names(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Names that are mostly ordinary words: written small at least as often as with the name's capitals."""
    tokens = texts.select(F.explode(F.regexp_extract_all("text", F.lit("([\\p{L}\\p{N}_]+)"), F.lit(1))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    keyed = names.select("name", F.lower("name").alias("l")).join(tokens.withColumn("l", F.lower("token")), "l")
    cap = F.sum(F.when(F.col("token") == F.col("name"), F.col("n")).otherwise(0))
    low = F.sum(F.when((F.col("token") != F.col("name")) & (F.col("token") == F.col("l")), F.col("n")).otherwise(0))
    counts = keyed.groupBy("name").agg(cap.alias("cap"), low.alias("low"))
    return counts.filter((F.col("low") >= F.greatest("cap", F.lit(1))) & (F.col("low") + F.col("cap") >= 3))


def first_pointers(hits: DataFrame, most: int = 20) -> DataFrame:
    """The first posts of each place and hour, by time and then uri."""
    w = Window.partitionBy("place_id", "hour").orderBy("at", "uri")
    return hits.withColumn("hour", F.date_trunc("hour", "at")).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def chatter_countries(posts: DataFrame, places: DataFrame) -> DataFrame:
    return posts.join(places.select("place_id", "country"), "place_id").groupBy("country", "hour").agg(F.sum("posts").alias("posts"))
