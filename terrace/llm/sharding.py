"""Sharding along a Hilbert curve over several metadata dimensions.

Each document falls into a cell of a small grid (source, language, size). Only the cells, whose number is bounded by
the grid, get a curve index; counts per cell, split further by an id hash where a cell is large, give every document
its global rank, and the ranks are cut into shards whose row counts differ by one at most. No sort of all rows, no
global window: the widest thing that is broadcast is the table of cells.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits per dimension; three dimensions give 4,096 cells at most.
BITS = 4
#: Rows of a cell that are ranked together; larger cells are split by a hash of the id.
RANK_ROWS = 2_000


def hilbert_index(dims: list[Column], bits: int = BITS) -> Column:
    """Hilbert curve index of a grid point, by the transpose method, as a fold over a small struct."""
    n = len(dims)
    state = F.struct(*[d.cast("long").alias(f"x{i}") for i, d in enumerate(dims)])

    def at(s: Column, i: int) -> Column:
        return s.getField(f"x{i}")

    def made(xs: list[Column]) -> Column:
        return F.struct(*[x.alias(f"x{i}") for i, x in enumerate(xs)])

    # Undo the excess work, from the top bit down; step k = level * n + i.
    def undo(s: Column, k: Column) -> Column:
        q = F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(bits - 1) - F.floor(k / n)).cast("int"))
        p, i = q - 1, k % n
        xi = reduce(lambda acc, j: F.when(i == j, at(s, j)).otherwise(acc), range(1, n), at(s, 0))
        swap = (at(s, 0).bitwiseXOR(xi)).bitwiseAND(p)
        hit = xi.bitwiseAND(q) != 0
        xs = []
        for j in range(n):
            if j == 0:
                xs.append(F.when(hit, at(s, 0).bitwiseXOR(p)).otherwise(at(s, 0).bitwiseXOR(swap)))
            else:
                xs.append(F.when(~hit & (i == j), at(s, j).bitwiseXOR(swap)).otherwise(at(s, j)))
        return made(xs)

    folded = F.aggregate(F.sequence(F.lit(0), F.lit((bits - 1) * n - 1)), state, undo)

    def gray(s: Column) -> Column:
        xs = [at(s, 0)]
        for j in range(1, n):
            xs.append(at(s, j).bitwiseXOR(xs[j - 1]))
        t = reduce(
            lambda acc, b: acc.bitwiseXOR(F.when(xs[n - 1].bitwiseAND(F.lit(1 << b).cast("long")) != 0, F.lit((1 << b) - 1).cast("long")).otherwise(F.lit(0).cast("long"))),
            range(1, bits),
            F.lit(0).cast("long"),
        )
        return made([x.bitwiseXOR(t) for x in xs])

    def joined(s: Column) -> Column:
        parts = [
            F.call_function("shiftleft", F.call_function("shiftright", at(s, j), F.lit(b)).bitwiseAND(F.lit(1).cast("long")), F.lit(b * n + n - 1 - j))
            for b in range(bits)
            for j in range(n)
        ]
        return reduce(lambda a, b: a + b, parts)

    one = F.array(folded)
    return F.transform(F.transform(one, gray), joined)[0]


def metadata_cells(docs: DataFrame, text: str, source: str, lang: str, bits: int = BITS) -> list[Column]:
    """Source and language by hash, size by its logarithm, each in [0, 2**bits)."""
    top = 1 << bits
    size = F.octet_length(F.coalesce(F.col(text), F.lit("")))
    name = lambda c: F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(top))
    return [name(source), name(lang), F.least(F.lit(top - 1), F.floor(F.log2(size + F.lit(1.0)) * 0.8))]


def shard(
    docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", bits: int = BITS, rank_rows: int = RANK_ROWS
) -> DataFrame:
    """Every row's shard and slot under the law ``rows``: shard sizes differ by one row at most.

    Null texts have no bytes (size 8, checksum 0); null metadata falls into the cell of the empty string; null ids and
    repeated rows are rows like any other. With fewer rows than shards the last shards stay empty. Extra columns are
    not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    s, g, z = metadata_cells(docs, text, source, lang, bits)
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body).cast("long") + 8).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        ((s * (1 << bits) + g) * (1 << bits) + z).cast("long").alias("cell"),
    )
    mix = F.xxhash64("doc_id", "text_crc32")
    side, cells = F.lit(1 << bits), rows.groupBy("cell").agg(F.count("*").alias("n"))
    cells = cells.withColumn("parts", F.ceil(F.col("n") / rank_rows).cast("long"))
    key = hilbert_index([F.floor(F.col("cell") / (side * side)), F.pmod(F.floor(F.col("cell") / side), side), F.pmod(F.col("cell"), side)], bits)
    cells = cells.select("cell", "parts", key.alias("curve"))
    # The cells are 2**(3 * bits) at most, so this is a bounded broadcast.
    rows = rows.join(F.broadcast(cells), "cell").withColumn("part", F.pmod(mix, F.col("parts")))
    groups = rows.groupBy("curve", "part").agg(F.count("*").alias("n"))
    # Curve parts grow with rows / rank_rows: still a table of counts. Its running sum goes curve range by curve range.
    by_curve = groups.groupBy("curve").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = by_curve.select("curve", before.alias("curve_start"), F.sum("n").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    offsets = groups.join(F.broadcast(starts), "curve").select("curve", "part", (F.col("curve_start") + F.col("inside")).alias("start"), "total")
    ranked = rows.withColumn("at", F.row_number().over(Window.partitionBy("curve", "part").orderBy("doc_id", "text_crc32", "size")) - 1)
    rank = (F.col("start") + F.col("at")).alias("rank")
    k = F.lit(shards).cast("long")
    out = ranked.join(offsets, ["curve", "part"]).select("doc_id", "size", "text_crc32", "curve", rank, "total")
    # Shard i holds the ranks [ceil(i * total / k), ceil((i + 1) * total / k)), in whole numbers.
    number = F.expr(f"(rank * {shards}) div total")
    first = F.expr(f"((rank * {shards}) div total * total + {shards - 1}) div {shards}")
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        number.cast("int").alias("shard"),
        (F.col("rank") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("curve").alias("curve_index"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24, doc_id: str = "doc_id", **names) -> None:
    """Write the documents as one folder per shard, in slot order, for file pruning. Needs unique ids."""
    where = shard(docs, shards, doc_id, **names).select(F.col("doc_id").alias(doc_id), "shard", "slot")
    docs.join(where, doc_id).repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
