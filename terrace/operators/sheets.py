"""A match sheet from lists of raw names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.functions.scalars import norm_name
from terrace.operators.joins import contains_match
from terrace.operators.names import best_name_match


def assemble_sheet(rated: DataFrame, contests: DataFrame, unavailable: DataFrame, kickers: DataFrame, block: list[str], name: str, min_score: float = 1.0) -> DataFrame:
    """T12. A row per rated player with the contest's percentage, whether and why unavailable, the set pieces; a starter
    is one with 50 percent or more, unknown without a contest.

    The three lists hold names as their pages spell them. A contest's name goes to the rated name of its block that fits
    best, whichever of the two is the shorter (J6); the others go to the first rated name that equals, contains or lies
    within theirs (J7). Where several lead to one player, the largest percentage and the first text by order count.
    """
    roster = rated.select(*block, F.col(name).alias("_full")).distinct().withColumn("_norm", norm_name(F.col("_full")))
    one = roster.groupBy(*block, "_norm").agg(F.min("_full").alias("_full"))

    def spelled(df: DataFrame) -> DataFrame:
        return df.select(*block, F.col(name).alias("_raw")).distinct().withColumn("_short", norm_name(F.col("_raw")))

    def resolved(df: DataFrame, hits: DataFrame, *cols) -> DataFrame:
        known = df.withColumnRenamed(name, "_raw").join(hits.select(*block, "_raw", "_full"), [*block, "_raw"])
        return known.groupBy(*block, F.col("_full").alias(name)).agg(*cols)

    fits = best_name_match(spelled(contests), roster, block, "_raw", "_short", "_full", "_norm", min_score, both_ways=True)
    within = lambda df: contains_match(spelled(df), roster, block, "_raw", "_short", "_norm", "_norm").join(one, [*block, "_norm"])
    out = rated
    for side in (
        resolved(contests, fits, F.max("pct").alias("pct")),
        resolved(unavailable, within(unavailable), F.min("reason").alias("reason"), F.lit(True).alias("_out")),
        resolved(kickers, within(kickers), F.min("set_piece").alias("set_piece"), F.lit(True).alias("_kicks")),
    ):
        out = out.join(side, [*block, name], "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    return out.select(*rated.columns, "pct", (F.col("pct") >= 50).alias("starter"), flag("_out").alias("unavailable"), "reason", flag("_kicks").alias("kicks"), "set_piece")
