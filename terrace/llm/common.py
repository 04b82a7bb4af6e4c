"""What the corpus operators share: inputs, scratch tables and Python batches."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch that goes to Python. Texts can be long, so Spark's 10,000 would hold too much at once.
BATCH_ROWS = 256

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Python workers import this package by name, and get small batches."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *parts])
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of our own only where none is named and all runs on this
    machine. A cluster without one is an error: its executors would not see each other's files."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/terrace-{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """What finished jobs have left goes: written tables that nothing reads any more, and, once the driver has collected
    its garbage, the shuffle files of queries that nobody holds."""
    jvm, own = spark.sparkContext._jvm, scratch_dir(spark)
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.rsplit("/", 1)[-1].startswith("terrace-"):
                at = jvm.org.apache.hadoop.fs.Path(f"{own}/{folder.rsplit('/', 1)[-1]}")
                at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    gc.collect()
    jvm.System.gc()


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have, whatever it has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def row_hash(text: Column) -> Column:
    """Tells rows that share an id (or have none) apart; null for a null text."""
    return F.when(text.isNotNull(), F.xxhash64(text))


def by_row(df: DataFrame, columns: list[str], schema: str, rows: Callable[..., list[tuple]]) -> DataFrame:
    """Apply ``rows(*column lists) -> list of tuples`` to each Arrow batch of the named columns."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    prepare(df.sparkSession)
    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = rows(*(b.column(i).to_pylist() for i in range(b.num_columns)))
            cols = list(zip(*got, strict=True)) if got else [[]] * len(out)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    return df.select(*columns).mapInArrow(run, schema)


def crc_bucket(doc_id: str, parts: int):
    """crc32 of the id as decimal text, modulo ``parts``: the held-out rule of the labelled tasks."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts
