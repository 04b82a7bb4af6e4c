"""Reading and writing tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

from terrace.functions.scalars import to_bool3, to_float

_TYPED = {
    StringType: lambda c: c,
    DoubleType: to_float,
    IntegerType: lambda c: c.try_cast("int"),
    LongType: lambda c: c.try_cast("bigint"),
    BooleanType: to_bool3,
    DateType: lambda c: F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd"),
    TimestampType: lambda c: c.try_cast("timestamp"),
}


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """S1. A header CSV read as text, then typed by the declared schema: ids stay text, bad cells become null."""
    text = StructType([StructField(f.name, StringType()) for f in schema.fields])
    raw = spark.read.schema(text).csv(path, header=True)
    return raw.select(*[_TYPED[type(f.dataType)](F.col(f.name)).alias(f.name) for f in schema.fields])


def union_seasons(frames: list[DataFrame]) -> DataFrame:
    """S2. One table of all seasons; columns in first-seen order, absent cells null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_optional(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """S3. The table, or an empty one where its file is absent."""
    return read_table(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def append_new(new: DataFrame, old: DataFrame, keys: list[str], one: bool = False) -> DataFrame:
    """S4. The rows whose key is not stored yet; with ``one`` a row per key, of those that share it the least by the other
    columns. A null in a key is a value like any other. ``load_batch`` also stores them."""
    rows, rest = new, [c for c in new.columns if c not in keys]
    if one:
        least = new.groupBy(*keys).agg(F.min(F.struct(F.lit(0), *rest)).alias("_row"))
        rows = least.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in new.columns])
    stored = old.select(*[F.col(k).alias(f"_old_{k}") for k in keys]).distinct()
    return rows.join(stored, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_old_{k}")) for k in keys]), "left_anti")


def _files(spark: SparkSession, pattern: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return [str(f.getPath()) for f in found or []]


def loads(spark: SparkSession, path: str) -> dict[str, str]:
    """S4. The loaded batches and the folder that holds each one's rows: as many as there were loads."""
    out: dict[str, str] = {}
    for mark in sorted(_files(spark, f"{path}/done/*/*")):
        batch, name = mark.rsplit("/", 2)[1:]
        out.setdefault(batch, f"{path}/rows/{name}")
    return out


def read_loads(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """S4. All rows of finished loads."""
    folders = loads(spark, path).values()
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def load_batch(new: DataFrame, path: str, keys: list[str], batch: str, one: bool = True) -> bool:
    """S4. Store the rows of a batch whose key is not stored yet, once: true if this call stored them. ``one`` as above.

    Rows go to a folder of their own; only a mark, an empty file that appears at once or not at all, makes them part of
    the table. A load that is killed leaves a folder without a mark, which nobody reads, and can be repeated; a finished
    one is not done again. Where two loads of one batch finish side by side, the mark that sorts first counts. Different
    batches are loaded one after the other.
    """
    spark = new.sparkSession
    if batch in loads(spark, path):
        return False
    name = uuid.uuid4().hex
    append_new(new, read_loads(spark, path, new.schema), keys, one).write.parquet(f"{path}/rows/{name}")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/done/{batch}/{name}")
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, False).close()
    return True


def write_features(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """S5. A feature table as Parquet, one folder per season."""
    out = df.write.mode(mode)
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)


def write_buckets(df: DataFrame, table: str, path: str, keys: list[str], buckets: int, mode: str = "overwrite") -> DataFrame:
    """S5. A table laid out by its keys, hashed to buckets and sorted inside them: joins, groupings and windows over these
    keys need no exchange, and joins of tables with as many buckets meet bucket by bucket. Returns the stored table."""
    df.repartition(buckets, *keys).write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def json_records(df: DataFrame, cols: list[Column], order: list[Column]) -> DataFrame:
    """S6. One JSON text per row, in order, nulls kept as null."""
    return df.orderBy(*order).select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"))


def export_json(df: DataFrame, path: str, cols: list[Column], order: list[Column]) -> None:
    """S6. Write the records as JSON lines."""
    json_records(df, cols, order).write.mode("overwrite").text(path)


def nest(df: DataFrame, keys: list[str], groups: dict[str, list[str]]) -> DataFrame:
    """S7. Named groups of columns as structs beside the keys."""
    return df.select(*keys, *[F.struct(*cols).alias(name) for name, cols in groups.items()])


def unpack_array(df: DataFrame, col: str, fields: dict[str, str]) -> DataFrame:
    """S8. A positional JSON array as named, typed columns; unreadable cells are null."""
    a = df.withColumn("_a", F.from_json(col, "array<string>"))
    return a.select(*df.columns, *[F.get("_a", F.lit(i)).try_cast(kind).alias(name) for i, (name, kind) in enumerate(fields.items())])
