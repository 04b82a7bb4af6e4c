"""Packing along a space-filling curve.

Every document becomes a hashed count vector of its byte trigrams, a fixed random projection brings it to a few
dimensions, and each dimension is cut at quantiles of all documents. Documents are range-sorted by the Hilbert index
of their grid cell, so neighbours in a sequence resemble each other; each range is encoded as one stream and cut every
1,024 ids. What is left at a range's end becomes sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from terrace.llm.common import prepare, settle
from terrace.llm.tokens import encoder, vocabulary_path

#: Hash width of the vectors, dimensions after projection, bits of each on the curve.
WIDTH, DIMS, BITS = 512, 3, 8
#: The quantiles' ranks are right within one part of this number.
ACCURACY = 10_000
LENGTH = 1024


@cache
def _projection(seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0], np.float32), (WIDTH, DIMS))


def project(text: str | None) -> np.ndarray:
    """The projected, length-normalised trigram vector of a text; zeros for fewer than three bytes."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if len(b) < 3:
        return np.zeros(DIMS, np.float32)
    w = b.astype(np.uint32)
    h = (w[:-2] * np.uint32(0x9E3779B1) ^ w[1:-1] * np.uint32(0x85EBCA77) ^ w[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(23)
    v = np.bincount(h, minlength=WIDTH).astype(np.float32)
    return (v / np.linalg.norm(v)) @ _projection()


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert indices of grid points (rows), vectorised over all of them."""
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            hit = (x[:, i] & q) != 0
            t = np.where(hit, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(hit, p, t)
            if i:
                x[:, i] ^= t
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[:, n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def pointed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text, p0, p1, ...``: the documents with their projected points, written once for all that follows."""
    @F.pandas_udf(ArrayType(FloatType()))
    def point(texts: pd.Series) -> pd.Series:
        return pd.Series([project(t) for t in texts])

    points = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), point(F.col(text)).alias("p"))
    return settle(points.select("doc_id", "text", *[F.col("p")[i].alias(f"p{i}") for i in range(DIMS)]), "points")


def curve_cuts(points: DataFrame) -> np.ndarray:
    """Quantile cuts of each projected dimension over all documents. A fixed number of values reaches the driver."""
    ranks = [float(x) for x in np.linspace(0, 1, (1 << BITS) + 1)[1:-1]]
    cuts = points.agg(*[F.percentile_approx(f"p{i}", ranks, ACCURACY) for i in range(DIMS)]).first()
    return np.array([c or [0.0] * len(ranks) for c in cuts], np.float32)


SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, padded bigint, curve bigint"


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", length: int = LENGTH, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: which ids of which document stand where in which sequence.

    Null texts count as empty: the end id alone. Repeated rows are packed like other rows; rows with a null id keep it.
    Equal texts of any number are spread by the id inside their cell, so a hot group fills several ranges. ``padded``
    is the stored length of the sequence: 1,024, or its own length where that is a power of two. Extra columns are not
    read. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    points = pointed(docs, doc_id, text)
    cuts = curve_cuts(points)

    @F.pandas_udf("bigint")
    def curve(*at: pd.Series) -> pd.Series:
        cells = np.stack([np.searchsorted(c, x.to_numpy(np.float32)) for c, x in zip(cuts, at, strict=True)], 1)
        return pd.Series(hilbert_keys(cells))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(vocabulary_path(vocabulary))
        end = np.array([end_id], "<u4").tobytes()
        sequence, filled = TaskContext.get().partitionId() << 32, 0
        held: list[list] = []  # the pieces of the open sequence, with their ids

        def rows(pieces: list[list], padded: int) -> list[tuple]:
            return [(d, s, len(x) // 4, zlib.crc32(x), n, q, o, padded, c) for d, s, x, n, q, o, c in pieces]

        def batch(got: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*got, strict=True)) if got else [[]] * 9
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

        for b in batches:
            ids, texts, keys = (b.column(i).to_pylist() for i in range(3))
            got: list[tuple] = []
            for d, c, x in zip(ids, keys, enc.encode([t or "" for t in texts]), strict=True):
                x += end
                n, at = len(x) // 4, 0
                while at < n:
                    take = min(n - at, length - filled)
                    held.append([d, at, x[4 * at : 4 * (at + take)], n, sequence, filled, c])
                    at, filled = at + take, filled + take
                    if filled == length:
                        got += rows(held, length)
                        sequence, filled, held = sequence + 1, 0, []
            yield batch(got)
        # The rest of the range: the binary digits of its length, largest first.
        got = []
        stream = [[d, s, x, n, c] for d, s, x, n, _, _, c in held]
        while filled:
            size = 1 << (filled.bit_length() - 1)
            room, part = size, []
            while room:
                d, s, x, n, c = stream[0]
                take = min(room, len(x) // 4)
                part.append([d, s, x[: 4 * take], n, sequence, size - room, c])
                stream[0] = [d, s + take, x[4 * take :], n, c]
                if not stream[0][2]:
                    stream.pop(0)
                room -= take
            got += rows(part, size)
            sequence, filled = sequence + 1, filled - size
        yield batch(got)

    keyed = points.select("doc_id", "text", curve(*[f"p{i}" for i in range(DIMS)]).alias("curve"))
    ordered = keyed.repartitionByRange("curve", "doc_id").sortWithinPartitions("curve", "doc_id", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return ordered.select("doc_id", "text", "curve").mapInArrow(run, SCHEMA)
