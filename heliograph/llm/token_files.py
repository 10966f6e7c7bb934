"""Token ids in files of independent zstandard frames, one a document, with a seek table at the end.

A file is: one frame for each document, in ascending doc_id order; a skippable frame with the documents'
ids; a skippable frame with the seek table of the public seekable format of zstandard (compressed size,
decompressed size and the low 32 bits of the XXH64 of each frame, then a nine-byte footer). A reader gets
the two tables from the end of the file and decompresses only the frames of the documents it wants; any
zstandard tool can still read the whole file, skipping the tables.

Ids take two bytes where the tokenizer has at most 65,536 of them, else four; the documents' table says
which. Writing: texts are encoded and compressed where they are read, the frames (about a tenth of the
text) are dealt by ranges of doc_id, sorted, and each task writes one file under a temporary name and
renames it, so a repeated attempt leaves the same file. Starts come from one row per file.

Nulls: a null text is empty and has only its end id; rows with a null doc_id come first. Repeated rows are
written as often as they come. A very long text is one frame. An empty table writes no file. Other columns are not written.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, new_folder, table
from .token_ids import default_tokenizer, document_ids

#: Fixed values of the public zstandard formats.
SKIPPABLE_DOCS, SKIPPABLE_SEEK, SEEK_MAGIC, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
END_ID, LEVEL, FILE_BYTES = 2, 3, 32 << 20
FRAMES = "doc_id long, n_tokens long, frame binary, checksum long"
FILES = "file string, first_id long, n_docs long, n_tokens long, n_bytes long"
DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def storage(path: str):
    """pyarrow's file system for a path of Spark's, and the path within it."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = f"file://{path[5:]}"
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def encode_frames(path: str, end_id: int, wide: bool, level: int):
    """A function for mapInArrow from (doc_id, text) to FRAMES."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=level)
        for batch in batches:
            n, frames, sums = [], [], []
            for text in batch.column("text"):
                ids = document_ids(path, text.as_py(), end_id)
                raw = ids.astype("<u4" if wide else "<u2").tobytes()
                n.append(len(ids))
                frames.append(squeeze.compress(raw))
                sums.append(xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(frames, pa.binary()), pa.array(sums, pa.int64())], names=["doc_id", "n_tokens", "frame", "checksum"])

    return run


def tables(ids: list[int | None], sizes: list[int], tokens: list[int], sums: list[int], width: int) -> bytes:
    """The two skippable frames at the end of a file."""
    here = np.array([x is not None for x in ids], dtype="u1").tobytes()
    docs = struct.pack("<BI", width, len(ids)) + here + np.array([x or 0 for x in ids], dtype="<i8").tobytes()
    seek = np.column_stack([sizes, np.array(tokens) * width, sums]).astype("<u4").tobytes() + struct.pack("<IBI", len(ids), CHECKSUMS, SEEK_MAGIC)
    return struct.pack("<II", SKIPPABLE_DOCS, len(docs)) + docs + struct.pack("<II", SKIPPABLE_SEEK, len(seek)) + seek


def write_files(folder: str, width: int):
    """A function for mapInArrow that writes a task's sorted FRAMES as one file and returns its row of FILES."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, base = storage(folder)
        name = f"part-{TaskContext.get().partitionId():09d}.zst"
        own = posixpath.join(base, f"_{name}.{uuid.uuid4().hex}")
        ids, sizes, tokens, sums, out, at = [], [], [], [], None, 0
        for batch in batches:
            if out is None and batch.num_rows:
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(own)
            for i, n, frame, check in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "n_tokens", "frame", "checksum")), strict=True):
                out.write(frame)
                ids.append(i)
                sizes.append(len(frame))
                tokens.append(n)
                sums.append(check)
                at += len(frame)
        if out is None:
            return
        out.write(end := tables(ids, sizes, tokens, sums, width))
        out.close()
        store.move(own, posixpath.join(base, name))
        yield pa.RecordBatch.from_pylist([{"file": f"{folder}/{name}", "first_id": ids[0], "n_docs": len(ids), "n_tokens": sum(tokens), "n_bytes": at + len(end)}], schema=pa.schema([("file", pa.string()), ("first_id", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]))

    return run


class TokenFile:
    """Reads documents of one file; frames other than those asked for are never decompressed."""

    def __init__(self, path: str):
        store, inner = storage(path)
        self.file = store.open_input_file(inner)
        end = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEK_MAGIC or flags != CHECKSUMS:
            raise ValueError(f"{path}: no seek table")
        seek = np.frombuffer(self._at(end - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype("i8")
        self.ends = np.cumsum(seek[:, 0])
        self.starts, self.raw, self.sums = self.ends - seek[:, 0], seek[:, 1], seek[:, 2]
        docs = self._at(int(self.ends[-1]) + 8, 5 + 9 * n)
        self.width = docs[0]
        here = np.frombuffer(docs[5 : 5 + n], "u1")
        self.ids = [int(x) if ok else None for x, ok in zip(np.frombuffer(docs[5 + n :], "<i8"), here, strict=True)]
        self.tokens = self.raw // self.width
        self.inflate = zstandard.ZstdDecompressor()

    def _at(self, start: int, n: int) -> bytes:
        return self.file.read_at(n, start)

    def frames(self, first: int, last: int) -> Iterator[np.ndarray]:
        """ids of documents first to last - 1 of the file, read in one piece, checked against the table."""
        low = int(self.starts[first])
        piece = self._at(low, int(self.ends[last - 1]) - low)
        for k in range(first, last):
            raw = self.inflate.decompress(piece[int(self.starts[k]) - low : int(self.ends[k]) - low], max_output_size=int(self.raw[k]))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"checksum of frame {k}")
            yield np.frombuffer(raw, f"<u{self.width}")

    def read(self, doc_id: int) -> list[np.ndarray]:
        """ids of every document with this doc_id."""
        return [next(self.frames(k, k + 1)) for k, x in enumerate(self.ids) if x == doc_id]


def read_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (file, base) to DOCS, 512 documents at a time."""
    for batch in batches:
        for path, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
            f = TokenFile(path)
            starts = base + np.cumsum(f.tokens) - f.tokens
            for a in range(0, len(f.ids), 512):
                b = min(a + 512, len(f.ids))
                crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in f.frames(a, b)]
                yield pa.RecordBatch.from_arrays([pa.array(f.ids[a:b], pa.int64()), pa.array(starts[a:b], pa.int64()), pa.array(f.tokens[a:b], pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, level: int = LEVEL, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes docs' ids below folder and returns FILES with base, the number of ids in all files before."""
    tokenizer = tokenizer or default_tokenizer()
    spark = docs.sparkSession
    from tokenizers import Tokenizer

    wide = max(end_id + 1, Tokenizer.from_file(tokenizer).get_vocab_size()) > 65536
    frames = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode_frames(tokenizer, end_id, wide, level), FRAMES)
    frames.write.option("compression", "none").parquet(staged := new_folder(spark, "frames"))
    frames = spark.read.schema(FRAMES).parquet(staged)
    size = frames.agg(F.sum(F.length("frame")).alias("n")).first()["n"] or 0
    dealt = frames.repartitionByRange(max(1, -(-size // file_bytes)), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "checksum")
    files = cut(dealt.mapInArrow(write_files(folder, 4 if wide else 2), FILES))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(files: DataFrame) -> DataFrame:
    """DOCS of all documents in the files, from the files alone."""
    n = max(1, files.count())
    return files.select("file", "base").repartition(n, "file").mapInArrow(read_rows, DOCS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), new_folder(spark, "token-files")))
