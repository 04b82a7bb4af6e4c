"""Filters and guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid_appearances(df: DataFrame, source: str, wanted: str, unrated: str, scores: list[str], season: str) -> DataFrame:
    """F1. Rows of the wanted source that are rated, whose scores parse and whose season is known."""
    keep = (F.col(source) == wanted) & (F.coalesce(F.col(unrated).cast("string"), F.lit("")) != "True") & F.col(season).isNotNull()
    for s in scores:
        keep &= F.col(s).isNotNull()
    return df.filter(keep)


def valid_matches(df: DataFrame, *needed: str) -> DataFrame:
    """F2. Matches whose scores and round are known."""
    for c in needed:
        df = df.filter(F.col(c).isNotNull())
    return df


def temporal_split(df: DataFrame, col: str, train: list, val: list, test: list) -> DataFrame:
    """F3. Column ``split`` by lists of seasons; null outside them."""
    c = F.col(col)
    return df.withColumn("split", F.when(c.isin(train), "train").when(c.isin(val), "val").when(c.isin(test), "test"))


def qualify_keys(df: DataFrame, key: str, min_train: int = 80, min_test: int = 8) -> DataFrame:
    """F4. Rows of the keys with enough train and test rows (column ``split``)."""
    counts = df.groupBy(key).agg(F.count_if(F.col("split") == "train").alias("a"), F.count_if(F.col("split") == "test").alias("b"))
    return df.join(counts.filter((F.col("a") >= min_train) & (F.col("b") >= min_test)).select(key), key, "left_semi")


def assert_no_leakage(df: DataFrame, forbidden: set[str]) -> DataFrame:
    """F5. The frame as it is, or an error that names the forbidden columns in it."""
    if found := sorted(set(df.columns) & set(forbidden)):
        raise ValueError(f"columns known only after the match: {', '.join(found)}")
    return df


def assert_feature_order(df: DataFrame, order: list[str]) -> DataFrame:
    """F6. Exactly the training columns in the training order; an error names what is missing."""
    if missing := [c for c in order if c not in df.columns]:
        raise ValueError(f"features missing: {', '.join(missing)}")
    return df.select(*order)


def split_scorable(prices: DataFrame, history: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """F7. Priced keys with a history row, and those without."""
    known = history.select(key).distinct()
    return prices.join(known, key, "left_semi"), prices.join(known, key, "left_anti")
