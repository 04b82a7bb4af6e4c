"""Deduplication and representative rows. Every choice has a total order given by the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """D1. The first row of each key. Filter afterwards, not before: a bad first row drops its key."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """D2. The last row of each key."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def majority(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """D3. The most frequent value of each key (smallest on ties), its count, and how many values the key has."""
    votes = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    # Counted first, so a group has one row per value.
    best = votes.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("less"), F.col(value).alias("value"))).alias("best"), F.count("*").alias("n_values"))
    return best.select(*keys, F.col("best.value").alias(value), (-F.col("best.less")).alias("n"), "n_values")


def ambiguous_keys(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """D3. One row: how many keys have more than one value."""
    return df.groupBy(*keys).agg(F.count_distinct(value).alias("n")).agg(F.count_if(F.col("n") > 1).alias("ambiguous"), F.count("*").alias("keys"))


def invert_map(df: DataFrame, source: str, target: str, order: list[str]) -> DataFrame:
    """D4. target -> the first source by order."""
    return df.groupBy(target).agg(F.min_by(source, F.struct(*order)).alias(source))


def representative(df: DataFrame, keys: list[str], mode_of: str, last_of: list[str], order: list[str]) -> DataFrame:
    """D5. Most frequent value of one column (smallest on ties) and the last seen values of others, per key."""
    return df.groupBy(*keys).agg(F.mode(mode_of, True).alias(mode_of), *[F.max_by(c, F.struct(*order)).alias(c) for c in last_of])


def canonical_names(df: DataFrame, col: str, normal: str) -> DataFrame:
    """D6. ``col, canonical``: names with equal first and last normalised token are one entity, whose name is the longest
    spelling (the smallest on ties). ``normal`` holds the normalised name."""
    parts = F.split(normal, " ")
    names = df.select(col, normal).distinct().select(col, parts[0].alias("_a"), F.element_at(parts, -1).alias("_b"))
    best = names.groupBy("_a", "_b").agg(F.min_by(col, F.struct(-F.length(col), F.col(col))).alias("canonical"))
    return names.join(best, ["_a", "_b"]).select(col, "canonical")
