"""Connected components of a link table, as joins and groupings over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import settle

#: Rounds after which a run is taken for a fault; the number needed grows with the logarithm of the largest diameter.
MOST_ROUNDS = 60


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of the undirected links; root is the smallest node of its component.

    Alternates large-star and small-star steps (each node's larger neighbours, then its smaller ones and itself, move to
    its smallest neighbour) until a round changes nothing. Each step is one grouping and one join on the node, both of
    which Spark can split; each round ends in a written table.
    """
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    edges = settle(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(MOST_ROUNDS):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        # Large star: neighbours above the node go to the smallest of the neighbourhood.
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        # Small star: over links turned downwards, the node and its smaller neighbours go to the smallest.
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        moved = large.join(low, "a")
        small = moved.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
        edges = settle(small.filter("a <> b").distinct(), "edges")
        # The same set of links as before: every component is a star.
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
