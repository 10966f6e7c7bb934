"""Documents turned into fill-in-the-middle examples, cut between lines.

A text's lines come from one `fullmatch` of a repeated group: the regex library keeps every repetition of a
group, so `ends(1)` is the list of all line ends, its length the number of lines, and an entry of it the
offset of a cut; nothing runs over the lines. Draws come from the SHA-256 of the seed and the doc_id, so a
rerun, a lost executor or another order of rows changes nothing. The two orders are prefix-suffix-middle
(`psm`) and suffix-prefix-middle (`spm`); `plain` texts stay as they are. `restore` rebuilds the exact text
from an output and its form alone.

Nulls: a null text is empty and plain; a null doc_id draws as an empty string of digits. Texts that hold a
marker are plain, so an output is always cut at the right places. Very long texts are matched whole, in
memory of some bytes a line. Repeated rows give equal results, each its own row. An empty table gives an
empty result. Columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

# The markers before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Every repetition of the group is a line with its end, or the last line without one; nothing is ever given back.
LINES = regex.compile(r"([^\n]*+\n|[^\n]++)*+")
#: Per cent of documents that are transformed, per cent of those in the order suffix, prefix, middle, and the seed of draws.
RATE, SPM, SEED = 100, 50, 7
FIELDS = {"doc_id": pa.int64(), "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()}
EXAMPLES = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four unsigned 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


def example(doc_id: int | None, text: str, rate: int = RATE, spm: int = SPM, seed: int = SEED) -> tuple[int, str, int | None, int | None, str]:
    """Lines, form, code points of prefix and middle, and output of a text."""
    ends = LINES.fullmatch(text).ends(1)
    n, (one, two, three, four) = len(ends), draws(doc_id, seed)
    if not text or three % 100 >= rate or any(x in text for x in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    low, high = sorted((one % (n + 1), two % (n + 1)))
    a, b = ends[low - 1] if low else 0, ends[high - 1] if high else 0
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if four % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def make_examples(rate: int, spm: int, seed: int):
    """A function for mapInArrow from (doc_id, text) to EXAMPLES."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            made = [example(i, t.as_py() or "", rate, spm, seed) for i, t in zip(ids, batch.column("text"), strict=True)]
            columns = zip(*((i, *x) for i, x in zip(ids, made, strict=True)), strict=True) if made else [()] * len(FIELDS)
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, FIELDS.values(), strict=True)], names=list(FIELDS))

    return run


def fill_in_middle(docs: DataFrame, rate: int = RATE, spm: int = SPM, seed: int = SEED) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every document, a row each."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(make_examples(rate, spm, seed), EXAMPLES)


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of. Markers stand in it once each, as texts that hold one stay plain."""
    head, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)
    inner = F.substring(head, len(PREFIX) + 1, F.length(head))  # without the first marker; all are of one length
    psm = F.concat(F.substring_index(inner, SUFFIX, 1), middle, F.substring_index(inner, SUFFIX, -1))
    spm = F.concat(F.substring_index(inner, PREFIX, -1), middle, F.substring_index(inner, PREFIX, 1))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    output, form = F.col("output"), F.col("form")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(output, 256).alias("output_sha256"), F.sha2(restore(output, form), 256).alias("restored_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS lines,
    ('0x' || x[1:8])::UBIGINT AS h1, ('0x' || x[9:16])::UBIGINT AS h2, ('0x' || x[17:24])::UBIGINT AS h3, ('0x' || x[25:32])::UBIGINT AS h4 FROM d),
k AS (SELECT *, len(lines) AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1))::BIGINT AS lo, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1))::BIGINT AS hi,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(lines[1:lo], ''), '') AS pre, coalesce(array_to_string(lines[lo + 1:hi], ''), '') AS mid, coalesce(array_to_string(lines[hi + 1:], ''), '') AS suf FROM k)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM p
"""
