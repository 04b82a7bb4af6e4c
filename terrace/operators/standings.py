"""Running standings and form, without a look ahead: a round sees strictly earlier rounds only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def team_round_spine(sides: DataFrame, season: str = "season", round_: str = "round", team: str = "team") -> DataFrame:
    """W1. Every team of a season with every round of that season, whether it plays or not."""
    teams, rounds = sides.select(season, team).distinct(), sides.select(season, round_).distinct()
    return teams.join(rounds, season)


def standings_before(sides: DataFrame, season: str = "season", round_: str = "round", team: str = "team") -> DataFrame:
    """W2, W3. Points, results and goals before each round, and the position by points, difference, goals scored, team.

    ``sides`` has a row per team and match with ``scored``, ``conceded``, ``points``. Matches are summed to a row per
    team and round before any window.
    """
    g = {
        "points": F.sum("points"),
        "won": F.count_if(F.col("points") == 3),
        "drawn": F.count_if(F.col("points") == 1),
        "lost": F.count_if(F.col("points") == 0),
        "scored": F.sum("scored"),
        "conceded": F.sum("conceded"),
    }
    per_round = sides.groupBy(season, round_, team).agg(*[v.cast("bigint").alias(k) for k, v in g.items()])
    spine = team_round_spine(sides, season, round_, team).join(per_round, [season, round_, team], "left")
    past = Window.partitionBy(season, team).orderBy(round_).rowsBetween(Window.unboundedPreceding, -1)
    run = spine.select(season, round_, team, *[F.coalesce(F.sum(c).over(past), F.lit(0)).cast("bigint").alias(c) for c in g])
    run = run.withColumn("difference", F.col("scored") - F.col("conceded"))
    rank = Window.partitionBy(season, round_).orderBy(F.desc("points"), F.desc("difference"), F.desc("scored"), team)
    return run.withColumn("position", F.row_number().over(rank))


def rolling_form(
    sides: DataFrame, values: list[str], windows: tuple[int, ...] = (3, 5), season: str = "season", round_: str = "round", team: str = "team", match: str = "match_id"
) -> DataFrame:
    """W4. Means of the values over the last 3 and 5 matches before the round, and how many there were.

    Matches are numbered per team by (round, match). A trailing window gives the state after match k; each spine row
    takes the state after as many matches as lie in earlier rounds: none gives nulls and 0. Means skip nulls.
    """
    order = Window.partitionBy(season, team).orderBy(round_, match)
    after = sides.select(
        season,
        team,
        F.row_number().over(order).cast("bigint").alias("_k"),
        *[F.avg(v).over(order.rowsBetween(-(w - 1), 0)).alias(f"form{w}_{v}") for w in windows for v in values],
        *[F.count("*").over(order.rowsBetween(-(w - 1), 0)).alias(f"form{w}_n") for w in windows],
    )
    played = sides.groupBy(season, round_, team).agg(F.count("*").alias("_n"))
    past = Window.partitionBy(season, team).orderBy(round_).rowsBetween(Window.unboundedPreceding, -1)
    spine = team_round_spine(sides, season, round_, team).join(played, [season, round_, team], "left").withColumn("_k", F.coalesce(F.sum("_n").over(past), F.lit(0)))
    out = spine.drop("_n").join(after, [season, team, "_k"], "left")
    return reduce(lambda d, w: d.withColumn(f"form{w}_n", F.coalesce(f"form{w}_n", F.lit(0))), windows, out).drop("_k")
