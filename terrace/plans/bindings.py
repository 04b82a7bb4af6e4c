"""The test tables in the roles of the domain: the same projections in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions.scalars import two_sided


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Ratings: a player's value in a round (day) of a season (three days), by source.
RATINGS_SQL = """ratings AS (
  SELECT event_id AS match_id, user_id AS player, event_type AS source, value AS rating,
    CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS round,
    CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 3 AS INTEGER) AS season,
    CAST(ts AS DATE) AS day
  FROM events)"""


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff("ts", F.lit("2024-01-01").cast("date"))
    return t(spark, sf_dir, "events").select(
        F.col("event_id").alias("match_id"),
        F.col("user_id").alias("player"),
        F.col("event_type").alias("source"),
        F.col("value").alias("rating"),
        day.cast("int").alias("round"),
        F.floor(day / 3).cast("int").alias("season"),
        F.to_date("ts").alias("day"),
    )


# Matches: one per order; a few home and away teams, goals from the price and the key.
MATCHES_SQL = """matches AS (
  SELECT o_orderkey AS match_id, CAST(year(o_orderdate) AS INTEGER) AS season, CAST(month(o_orderdate) AS INTEGER) AS round,
    CAST(o_orderdate AS DATE) AS day, o_custkey % 20 AS home, (o_orderkey // 7) % 20 AS away,
    CAST(floor(o_totalprice) AS BIGINT) % 5 AS home_goals, o_orderkey % 4 AS away_goals
  FROM orders WHERE o_custkey % 20 <> (o_orderkey // 7) % 20)"""
SIDES_SQL = (
    MATCHES_SQL
    + """, sides AS (
  SELECT *, CASE WHEN scored > conceded THEN 3 WHEN scored = conceded THEN 1 ELSE 0 END AS points FROM (
    SELECT match_id, season, round, day, home AS team, away AS opponent, true AS is_home, home_goals AS scored, away_goals AS conceded FROM matches
    UNION ALL
    SELECT match_id, season, round, day, away, home, false, away_goals, home_goals FROM matches))"""
)


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    home, away = F.col("o_custkey") % 20, F.floor(F.col("o_orderkey") / 7) % 20
    return t(spark, sf_dir, "orders").filter(home != away).select(
        F.col("o_orderkey").alias("match_id"),
        F.year("o_orderdate").alias("season"),
        F.month("o_orderdate").alias("round"),
        F.to_date("o_orderdate").alias("day"),
        home.alias("home"),
        away.alias("away"),
        (F.floor("o_totalprice") % 5).alias("home_goals"),
        (F.col("o_orderkey") % 4).alias("away_goals"),
    )


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_sided(matches(spark, sf_dir), ["match_id", "season", "round", "day"], "home", "away", "home_goals", "away_goals")
