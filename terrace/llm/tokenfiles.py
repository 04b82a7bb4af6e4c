"""Token files: one concatenated id array with Elias-Fano coded document ends.

A file holds whole documents in ascending id order::

    magic   8 bytes  b"TEFIDS01"
    header  5 x u64  documents n, ids u, low bits l, bytes of the upper part, id width in bytes
    doc ids n x i64, null flags n bits
    lower   n x l bits, upper n + (u >> l) bits (Elias-Fano of the n exclusive document ends)
    ids     u x width, little endian

Document i's end is (select1(upper, i) - i) << l | lower[i]: about 2 + log2(u / n) bits a document in place of 64.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.llm.common import prepare, scratch_path, settle
from terrace.llm.tokens import encoder, vocabulary_path

MAGIC = b"TEFIDS01"
_HEADER = struct.Struct("<5Q")
#: Ids of a file, about; a file is read whole by one task. It ends with the document that reaches this.
FILE_IDS = 1_000_000
#: Documents whose ends are looked up together when a file is read.
SELECTED = 4_096


class EliasFano:
    """A monotone sequence of numbers, each at most ``universe``, in near minimal space."""

    def __init__(self, n: int, low_bits: int, lower: np.ndarray, upper: np.ndarray) -> None:
        self.n, self.low_bits, self.lower, self.upper = n, low_bits, lower, upper
        bits = np.unpackbits(upper, bitorder="little")
        # Rank directory: ones before each word of 512 bits, for select without a table of all values.
        pad = (-len(bits)) % 512
        self.ranks = np.concatenate([[0], np.cumsum(np.pad(bits, (0, pad)).reshape(-1, 512).sum(1, dtype=np.int64))])

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> EliasFano:
        v, n = values.astype(np.int64), len(values)
        low = max(0, int(universe // max(n, 1)).bit_length() - 1)
        bits = ((v[:, None] >> np.arange(low)) & 1).astype(np.uint8).ravel() if low else np.zeros(0, np.uint8)
        upper = np.zeros(n + (universe >> low) + 1, np.uint8)
        upper[(v >> low) + np.arange(n)] = 1
        return cls(n, low, np.packbits(bits, bitorder="little"), np.packbits(upper, bitorder="little"))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        at = i[:, None] * self.low_bits + np.arange(self.low_bits)
        return (((self.lower[at >> 3] >> (at & 7)) & 1).astype(np.int64) << np.arange(self.low_bits)).sum(1)

    def select(self, i: int) -> int:
        """Value number i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.select_range(i, i + 1)[0])

    def select_range(self, first: int, end: int) -> np.ndarray:
        """Values ``first`` to ``end`` - 1: the directory names the blocks of 512 bits that hold their ones, and only
        those are unpacked."""
        if first >= end:
            return np.zeros(0, np.int64)
        a, b = np.searchsorted(self.ranks, (first, end - 1), "right") - 1
        bits = np.unpackbits(self.upper[64 * a : 64 * (b + 1)], bitorder="little")
        at = 512 * a + np.flatnonzero(bits)[first - self.ranks[a] : end - self.ranks[a]]
        i = np.arange(first, end)
        return ((at - i) << self.low_bits) | self._low(i)

    def all(self) -> np.ndarray:
        i = np.arange(self.n)
        at = np.flatnonzero(np.unpackbits(self.upper, bitorder="little"))[: self.n]
        return ((at - i) << self.low_bits) | self._low(i)


def pack_file(doc_ids: list[int | None], id_bytes: list[bytes], width: int) -> bytes:
    """One file's bytes; ``id_bytes`` are little-endian uint32 ids of each document."""
    ends = np.cumsum([len(x) // 4 for x in id_bytes], dtype=np.int64) if id_bytes else np.zeros(0, np.int64)
    u = int(ends[-1]) if len(ends) else 0
    ef = EliasFano.encode(ends, u)
    ids = np.frombuffer(b"".join(id_bytes), "<u4").astype(f"<u{width}")
    known = np.array([0 if d is None else d for d in doc_ids], "<i8")
    null = np.packbits(np.array([d is None for d in doc_ids], np.uint8), bitorder="little")
    head = MAGIC + _HEADER.pack(len(doc_ids), u, ef.low_bits, len(ef.upper), width)
    return b"".join([head, known.tobytes(), null.tobytes(), ef.lower.tobytes(), ef.upper.tobytes(), ids.tobytes()])


def unpack_file(data: bytes) -> tuple[list[int | None], EliasFano, np.ndarray]:
    """Document ids, their coded ends and the id array of a file."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    n, u, low, upper_bytes, width = _HEADER.unpack_from(data, 8)
    at = 8 + _HEADER.size

    def take(count: int, kind: str) -> np.ndarray:
        nonlocal at
        x = np.frombuffer(data, kind, count, at)
        at += x.nbytes
        return x

    known, null = take(n, "<i8"), take((n + 7) // 8, "u1")
    lower, upper = take((n * low + 7) // 8, "u1"), take(upper_bytes, "u1")
    ids = take(u, f"<u{width}")
    gone = np.unpackbits(null, bitorder="little")[:n]
    return [None if g else int(d) for d, g in zip(known, gone, strict=True)], EliasFano(n, low, lower, upper), ids


def write_token_files(
    docs: DataFrame, folder: str, vocabulary: str = "word_bpe_49k.json", end_id: int = 1, doc_id: str = "doc_id", text: str = "text", file_ids: int = FILE_IDS
) -> DataFrame:
    """Encode all documents, write token files in ascending id order, return the manifest: one row per file.

    A file appears under its final name in one move, and its content is the same however often a task runs. The folder
    must be one that all executors share.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        part = task.partitionId()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        enc = encoder(vocabulary_path(vocabulary))
        width = 2 if enc.tokenizer.get_vocab_size() <= 1 << 16 else 4
        end = np.array([end_id], "<u4").tobytes()
        ids: list = []
        held: list[bytes] = []
        size = number = 0
        made = []

        def flush() -> None:
            nonlocal ids, held, size, number
            if not ids:
                return
            name = f"{part:06d}-{number:06d}.efids"
            temp = f"{base}/_{name}-{task.taskAttemptId()}"
            with store.open_output_stream(temp) as f:
                f.write(pack_file(ids, held, width))
            store.move(temp, f"{base}/{name}")
            made.append((name, part, number, len(ids), size))
            ids, held, size, number = [], [], 0, number + 1

        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), enc.encode([t or "" for t in b.column(1).to_pylist()]), strict=True):
                ids.append(d)
                held.append(x + end)
                size += len(x) // 4 + 1
                if size >= file_ids:
                    flush()
        flush()
        cols = list(zip(*made, strict=True)) if made else [[]] * 5
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["file", "part", "number", "documents", "ids"])

    body = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    ordered = body.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    made = ordered.mapInArrow(run, "file string, part int, number int, documents bigint, ids bigint")
    manifest = settle(made, "manifest")
    # Two levels: files inside a range, then the ranges, of which there are as many as tasks.
    ranges = manifest.groupBy("part").agg(F.sum("ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("ids").over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return manifest.withColumn("inside", inside).join(F.broadcast(ranges.select("part", before.alias("before"))), "part").select("file", "documents", "ids", (F.col("before") + F.col("inside")).alias("start"))


READ_SCHEMA = "file string, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint"


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document, from the files: its place in the corpus-wide id array, length and checksum."""
    step = SELECTED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids, ends, tokens = unpack_file(data.as_py())
                raw = tokens.astype("<u4")
                # Ends come from the select structure, some documents at a time: no table of all of them.
                last = 0
                for k in range(0, ends.n, step):
                    stop = ends.select_range(k, min(ends.n, k + step))
                    start = np.concatenate([[last], stop[:-1]]).astype(np.int64)
                    last = int(stop[-1])
                    crc = [zlib.crc32(raw[i:j]) for i, j in zip(start, stop, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(stop)), pa.array(ids[k : k + step], pa.int64()), pa.array(start), pa.array(stop - start), pa.array(crc, pa.int64())],
                        names=["file", "doc_id", "at", "n_tokens", "ids_crc32"],
                    )

    spark = manifest.sparkSession
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[0-9]*.efids").load(folder)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    read = named.mapInArrow(run, READ_SCHEMA)
    # A row per file: as many as the corpus has ids / FILE_IDS, so Spark decides how to join.
    return read.join(manifest, "file").select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, **options) -> DataFrame:
    """Write all documents as token files in the shared folder and read them back, one row per document.

    Null texts count as empty and give the end id alone; null ids come first; repeated rows each get their place.
    Extra columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "tokens")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)
    return read_token_files(write_token_files(docs, folder, **options), folder)
