"""Cutting the lineage of jobs that go in rounds; partitions that follow a table's size."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a partition that ``dealt`` aims at.
ROWS = 250_000


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names. A folder of our own is set only where none is named and all runs on
    this machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not at and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(at or "file://" + tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """The table, computed once and kept in the shared checkpoint folder, so that lost executors cost nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The table by its keys' hash, over partitions whose number grows with its rows, which are counted first: so a task
    sorts and groups no more of a large table than of a small one, whatever the session's number of partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-df.count() // ROWS)), *keys)
