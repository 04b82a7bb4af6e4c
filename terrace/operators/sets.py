"""Set operations on keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_by_name(a: DataFrame, b: DataFrame) -> DataFrame:
    """U1. Rows of both; columns by name, absent ones null."""
    return a.unionByName(b, allowMissingColumns=True)


def key_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """U2. Keys of one side only, with the side they are on."""
    ka, kb = a.select(*keys).distinct(), b.select(*keys).distinct()
    return ka.join(kb, keys, "left_anti").withColumn("side", F.lit("left")).unionByName(kb.join(ka, keys, "left_anti").withColumn("side", F.lit("right")))


def restrict_to_keys(df: DataFrame, keys_df: DataFrame, on: list[str]) -> DataFrame:
    """U3. The rows whose key is in the key table."""
    return df.join(keys_df.select(*on).distinct(), on, "left_semi")
