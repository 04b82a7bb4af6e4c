"""Rankings and ordered reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.operators.rounds import settled


def summed_before(df: DataFrame, by: str, order: list[Column], weight: Column, name: str) -> DataFrame:
    """The table with ``name``: the weights of all rows of the same group that come before a row in the order, summed.

    Rows are dealt to ranges of (group, order) and kept in the shared folder, so that every step below sees the same
    ranges. Running sums go range by range, on top of the sum of the ranges before: a group of any size is spread over
    as many tasks as it fills. The order must tell all rows of a group apart for the result to be defined.
    """
    dealt = settled(df.repartitionByRange(F.col(by), *order).withColumn("_range", F.spark_partition_id()))
    # One row for each group in each range.
    sums = dealt.groupBy(F.col(by).alias("_by"), F.col("_range").alias("_at")).agg(F.sum(weight).alias("_sum"))
    earlier = Window.partitionBy("_by").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_by", "_at", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range", by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.withColumn(name, F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    both = rows.join(starts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_at")))
    return both.withColumn(name, F.col(name) + F.col("_start")).select(*df.columns, name)


#: Rows of a group that one task ranks.
GROUP_ROWS = 1_000_000


def rank_divergence(df: DataFrame, by: str, a: str, b: str, ties: list[str], cut: float = 1.0, group_rows: int = GROUP_ROWS) -> DataFrame:
    """W12. Ranks by both values inside a group, their difference, the difference in population deviations of the group,
    and a verdict from the cut on. Equal values rank by ``ties``, nulls last.

    The size of the largest group is counted first. Up to ``group_rows`` all is windows over the group: one exchange,
    nothing kept. Beyond that ranks come from sorted ranges, and a group may have any size.
    """
    largest = df.groupBy(by).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0
    out, whole = df, Window.partitionBy(by)
    for c, rank in ((a, "rank_a"), (b, "rank_b")):
        order = [F.desc_nulls_last(c), *map(F.col, ties)]
        if largest <= group_rows:
            out = out.withColumn(rank, F.row_number().over(whole.orderBy(*order)))
        else:
            out = summed_before(out, by, order, F.lit(1), rank).withColumn(rank, (F.col(rank) + 1).cast("int"))
    out = out.withColumn("divergence", F.col("rank_a") - F.col("rank_b"))
    if largest <= group_rows:
        out = out.withColumn("_spread", F.stddev_pop("divergence").over(whole))
    else:
        spread = out.groupBy(F.col(by).alias("_by")).agg(F.stddev_pop("divergence").alias("_spread"))
        out = out.join(spread, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
    out = out.withColumn("z", F.when(F.col("_spread") > 0, F.col("divergence") / F.col("_spread"))).drop("_spread")
    return out.withColumn("verdict", F.when(F.col("z") >= cut, "undervalued").when(F.col("z") <= -cut, "overvalued").otherwise("aligned"))


def top_k(df: DataFrame, by: list[str], score, k: int, ties: list[str]) -> DataFrame:
    """W13. The k rows of each group with the largest score; nulls last, equal scores by ``ties``."""
    w = Window.partitionBy(*by).orderBy(score.desc_nulls_last(), *ties)
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def report_order(df: DataFrame, team: str, price: str, name: str) -> DataFrame:
    """W13. By team, then falling price with none as 0, then name."""
    return df.orderBy(team, F.coalesce(F.col(price), F.lit(0.0)).desc(), name)
