"""Whole jobs: the operators chained as the feature tables and reports need them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from terrace.functions.scalars import norm_name, select_base
from terrace.operators import aggs, dedup, guards, inference, joins, lags, names, ranking, standings
from terrace.operators.rounds import shared_path
from terrace.plans.bindings import RATINGS_SQL, ratings, sides, t
from terrace.plans.q_features import _STAND, _WALK, _pairs
from terrace.plans.registry import SQL, query
from terrace.sources import tables


_STATE = ("position", "points", "difference", "form3_points", "form3_scored", "form3_xg", "form3_n")


@query(
    "job_prematch_features",
    _STAND
    + f""", shots AS (SELECT l_orderkey AS match_id, sum(CASE WHEN l_linestatus = 'O' THEN l_discount ELSE 0 END) AS xg_home, sum(CASE WHEN l_linestatus <> 'O' THEN l_discount ELSE 0 END) AS xg_away FROM lineitem GROUP BY ALL),
    played AS (SELECT sides.*, xg_home IS NOT NULL AS has_shots, CASE WHEN is_home THEN xg_home ELSE xg_away END AS xg FROM sides LEFT JOIN shots USING (match_id)),
    back AS (SELECT s.season, s.team, s.round, m.points, m.scored, m.xg, row_number() OVER (PARTITION BY s.season, s.team, s.round ORDER BY m.round DESC, m.match_id DESC) AS k FROM spine s JOIN played m ON m.season = s.season AND m.team = s.team AND m.round < s.round),
    form AS (SELECT season, team, round, round(avg(points), 6) AS form3_points, round(avg(scored), 6) AS form3_scored, round(avg(xg), 6) AS form3_xg, count(k) AS form3_n FROM spine LEFT JOIN (SELECT * FROM back WHERE k <= 3) USING (season, team, round) GROUP BY ALL),
    state AS (SELECT * FROM standing JOIN form USING (season, team, round)),
    r AS (SELECT l_suppkey % 20 AS team, CAST(l_shipdate AS DATE) AS day, max(l_extendedprice) AS v FROM lineitem GROUP BY ALL)
    SELECT s.match_id, s.season, s.round, s.team, s.opponent, s.is_home, {', '.join(f'{q}.{c} AS {n}_{c}' for q, n in (('o', 'own'), ('p', 'opp')) for c in _STATE)},
      coalesce(o0.v, o1.v, o2.v) AS own_lineup, coalesce(p0.v, p1.v, p2.v) AS opp_lineup, has_shots
    FROM played s JOIN state o ON o.season = s.season AND o.round = s.round AND o.team = s.team JOIN state p ON p.season = s.season AND p.round = s.round AND p.team = s.opponent
    {' '.join(f'LEFT JOIN r {q}{i} ON {q}{i}.team = s.{c} AND {q}{i}.day = s.day + ({by})' for q, c in (('o', 'team'), ('p', 'opponent')) for i, by in enumerate((0, 1, -1)))}""",
)
def prematch(spark, d):
    """Job A: every side of every match with both teams' standing and form (points, goals, xG) before the round and their
    line-ups of the day or one beside it. Goals, points and xG of the match itself stay out."""
    rows = sides(spark, d)
    li = t(spark, d, "lineitem")
    shots = aggs.by_side(li.withColumns({"xg": F.col("l_discount"), "match_id": F.col("l_orderkey")}), ["match_id"], "l_linestatus", "O", "xg")
    played = rows.join(shots, "match_id", "left").withColumns({"has_shots": F.col("xg_home").isNotNull(), "xg": F.when(F.col("is_home"), F.col("xg_home")).otherwise(F.col("xg_away"))})
    form = standings.rolling_form(played, ["points", "scored", "xg"], (3,)).withColumns({f"form3_{c}": F.round(f"form3_{c}", 6) for c in ("points", "scored", "xg")})
    state = standings.standings_before(rows).drop("scored", "conceded").join(form, ["season", "round", "team"])
    line_ups = li.select((F.col("l_suppkey") % 20).alias("team"), F.to_date("l_shipdate").alias("day"), F.col("l_extendedprice").alias("lineup"))
    out = played.select("match_id", "season", "round", "day", "team", "opponent", "is_home", "has_shots")
    for who, prefix in (("team", "own_"), ("opponent", "opp_")):
        out = joins.lookup(out, state, {"season": "season", "round": "round", who: "team"}, prefix, list(_STATE))
        seen = line_ups.withColumnRenamed("team", who)
        out = joins.join_within_days(out, seen, [who], "day", ["lineup"], ["lineup"]).drop("day_offset").withColumnRenamed("lineup", f"{prefix}lineup")
    return guards.assert_no_leakage(out.drop("day"), {"home_goals", "away_goals", "scored", "conceded", "points", "xg", "xg_home", "xg_away"})


_PLAYER_STATE = ("position", "points", "difference")


@query(
    "job_prematch_player_features",
    _STAND
    + f""", players AS (SELECT l_orderkey AS match_id, l_suppkey AS player, max(l_linestatus) = 'O' AS is_home, sum(l_quantity) AS rating FROM lineitem GROUP BY ALL),
    seen AS (SELECT match_id, player, season, round, day, team, opponent, rating FROM players JOIN sides USING (match_id, is_home)),
    lagged AS (SELECT *, round(avg(rating) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS rating_lag3, round(avg(rating) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS rating_lag5, count(*) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS earlier FROM seen WINDOW w AS (PARTITION BY player ORDER BY day, match_id))
    SELECT l.match_id, l.player, l.season, l.round, l.team, l.opponent, rating_lag3, rating_lag5, earlier, {', '.join(f'{q}.{c} AS {n}_{c}' for q, n in (('o', 'own'), ('p', 'opp')) for c in _PLAYER_STATE)}
    FROM lagged l JOIN standing o ON o.season = l.season AND o.round = l.round AND o.team = l.team JOIN standing p ON p.season = l.season AND p.round = l.round AND p.team = l.opponent""",
)
def prematch_players(spark, d):
    """Job A for players: everybody who plays a match, with the means of their last ratings across seasons, how often they
    played before, and both teams' standing before the round. The match's own rating stays out."""
    li = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("match_id"), F.col("l_suppkey").alias("player")).agg((F.max("l_linestatus") == "O").alias("is_home"), F.sum("l_quantity").alias("rating"))
    s = sides(spark, d)
    seen = li.join(s.select("match_id", "is_home", "season", "round", "day", "team", "opponent"), ["match_id", "is_home"])
    out = lags.player_lags(seen, "player", ["day", "match_id"], {"rating_lag3": ("rating", 3), "rating_lag5": ("rating", 5)}).withColumns({c: F.round(c, 6) for c in ("rating_lag3", "rating_lag5")})
    state = standings.standings_before(s)
    for who, prefix in (("team", "own_"), ("opponent", "opp_")):
        out = joins.lookup(out, state, {"season": "season", "round": "round", who: "team"}, prefix, list(_PLAYER_STATE))
    return guards.assert_no_leakage(out.drop("day", "is_home", "rating"), {"rating", "scored", "conceded", "home_goals", "away_goals"})


#: The season's metrics: sums, extremes and counts by kind. Each is one SQL expression, the same in both.
_KINDS = {"urgent": "o_orderpriority = '1-URGENT'", "high": "o_orderpriority = '2-HIGH'", "medium": "o_orderpriority = '3-MEDIUM'", "plain": "o_orderpriority = '4-NOT SPECIFIED'", "low": "o_orderpriority = '5-LOW'"}
_KINDS |= {"finished": "o_orderstatus = 'F'", "open": "o_orderstatus = 'O'", "partly": "o_orderstatus = 'P'", "spring": "month(o_orderdate) <= 6", "large": "o_totalprice > 200000"}
_METRIC_OF = {"spent": "round(sum(o_totalprice), 2)", "units": "CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT)", "n": "count(*)", "top": "max(o_totalprice)", "least": "min(o_totalprice)", "span": "max(o_totalprice) - min(o_totalprice)"}
_METRIC_OF |= {k: f"count(CASE WHEN {v} THEN 1 END)" for k, v in _KINDS.items()}
_METRICS = tuple(_METRIC_OF)
_SEASONS = f"spend AS (SELECT o_custkey AS player, CAST(year(o_orderdate) AS INTEGER) AS season, {', '.join(f'{v} AS {k}' for k, v in _METRIC_OF.items())} FROM orders GROUP BY ALL)"


@query(
    "job_player_season_table",
    f"""WITH {_SEASONS}, p AS (SELECT a.player, a.season, a.spent AS target, a.n AS target_n FROM spend a JOIN spend b ON a.player = b.player AND a.season = b.season + 1),
    w AS (SELECT player, season, {', '.join(f"CAST(lag({m}) OVER o AS DOUBLE) AS {m}_lag1, avg({m}) OVER l AS {m}_mean, stddev_pop({m}) OVER l AS {m}_std, count({m}) OVER l AS {m}_k, first_value({m}) OVER l AS {m}_f, last_value({m}) OVER l AS {m}_l, avg({m}) OVER f AS {m}_career" for m in _METRICS)}, count(*) OVER f AS earlier FROM spend
      WINDOW o AS (PARTITION BY player ORDER BY season), l AS (PARTITION BY player ORDER BY season RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING), f AS (PARTITION BY player ORDER BY season RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    e AS (SELECT o_custkey AS player, CAST(year(o_orderdate) AS INTEGER) AS es, CAST(o_orderkey % 40 AS DOUBLE) AS days FROM orders),
    i AS (SELECT s.player, s.season, count(es) FILTER (WHERE es = s.season - 1) AS injuries_prev, coalesce(sum(days) FILTER (WHERE es = s.season - 1), 0.0) AS days_prev, count(es) FILTER (WHERE es < s.season) AS injuries_career FROM spend s LEFT JOIN e ON e.player = s.player GROUP BY ALL),
    b AS (SELECT o_custkey AS player, CAST(year(o_orderdate) AS INTEGER) AS season, o_orderpriority AS role, count(*) AS k FROM orders GROUP BY ALL),
    v AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY player, season ORDER BY k DESC, role) = 1)
    SELECT player, season, target, target_n, {', '.join(f"{m}_lag1, round({m}_mean, 4) AS {m}_mean, CASE WHEN {m}_k >= 2 THEN round({m}_std, 4) END AS {m}_std, CASE WHEN {m}_k >= 2 THEN round(({m}_l - {m}_f) / ({m}_k - 1), 4) END AS {m}_trend, round({m}_career, 4) AS {m}_career" for m in _METRICS)}, earlier AS earlier_seasons,
      injuries_prev, days_prev, injuries_career, role, c_mktsegment AS segment, n_name AS nation, round(c_acctbal / 100, 2) AS price, CASE WHEN c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS in_region,
      CASE WHEN season < 2000 THEN 'train' WHEN season = 2000 THEN 'val' ELSE 'test' END AS split
    FROM p JOIN w USING (player, season) JOIN i USING (player, season) JOIN v USING (player, season) LEFT JOIN customer ON player = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""",
)
def player_season(spark, d):
    """Job B: one row per player and season with a season before: targets, earlier seasons of every metric, injuries of
    earlier seasons, the role seen most, profile, price, split."""
    agg = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("player"), F.year("o_orderdate").alias("season")).agg(*[F.expr(v).alias(k) for k, v in _METRIC_OF.items()])
    spine = joins.with_previous_season(agg.select("player", "season", F.col("spent").alias("target"), F.col("n").alias("target_n")), "player", "season", [])
    feats = lags.season_features(agg, "player", "season", list(_METRICS))
    rounded = {f"{m}_{k}": F.round(f"{m}_{k}", 4) for m in _METRICS for k in ("mean", "std", "trend", "career")}
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("player"), F.year("o_orderdate").alias("season"), F.col("o_orderpriority").alias("role"), (F.col("o_orderkey") % 40).cast("double").alias("days"))
    hurt = aggs.injury_features(agg, o, "player", "season", "days")
    role = dedup.majority(o, ["player", "season"], "role").select("player", "season", "role")
    out = spine.join(feats.withColumns(rounded), ["player", "season"]).join(hurt, ["player", "season"]).join(role, ["player", "season"])
    return _player_season_row(spark, d, out)


def _player_season_row(spark, d, out):
    """The rest of job B: profile, nation, price, split and the order of columns."""
    people = t(spark, d, "customer").withColumn("price", F.round(F.col("c_acctbal") / 100, 2))
    out = joins.lookup(out, people, {"player": "c_custkey"}, "", ["c_mktsegment", "c_nationkey", "price"])
    out = joins.lookup(out, t(spark, d, "nation"), {"c_nationkey": "n_nationkey"}, "", ["n_name", "n_regionkey"])
    out = out.withColumn("in_region", F.coalesce((F.col("n_regionkey") == 0).cast("double"), F.lit(0.0)))
    out = guards.temporal_split(out, "season", list(range(1990, 2000)), [2000], [2001, 2002])
    of = [f"{m}_{k}" for m in _METRICS for k in ("lag1", "mean", "std", "trend", "career")]
    named = out.withColumnsRenamed({"c_mktsegment": "segment", "n_name": "nation"})
    return select_base(named, ["player", "season", "target", "target_n", *of, "earlier_seasons", "injuries_prev", "days_prev", "injuries_career", "role", "segment", "nation", "price", "in_region", "split"], {})


@query("job_player_season_stored", SQL["job_player_season_table"])
def player_season_stored(spark, d):
    """Job B over facts that are stored in buckets by player: groupings and windows read them as they lie, and no row of
    the fact side is exchanged. Equal to the job above."""
    name = f"facts_{uuid.uuid4().hex}"
    orders = t(spark, d, "orders").withColumnsRenamed({"o_custkey": "player"})
    return _player_season_row(spark, d, season_rows(tables.write_buckets(orders, name, shared_path(spark, name), ["player"], 8)))


def season_rows(orders):
    """Targets, features, injuries and role of each player's seasons, from orders by player."""
    own = {"role": F.mode("o_orderpriority", True), "_hurt": F.count("*"), "_days": F.sum((F.col("o_orderkey") % 40).cast("double"))}
    agg = orders.groupBy("player", F.year("o_orderdate").alias("season")).agg(*[F.expr(v).alias(k) for k, v in _METRIC_OF.items()], *[v.alias(k) for k, v in own.items()])
    feats = lags.season_features(agg, "player", "season", list(_METRICS), keep=["spent", "n", *own])
    rounded = {f"{m}_{k}": F.round(f"{m}_{k}", 4) for m in _METRICS for k in ("mean", "std", "trend", "career")}
    out = feats.withColumns(rounded).select("*", *aggs.injury_columns("player", "season", F.col("_hurt"), F.col("_days")))
    return joins.with_previous_season(out.withColumnsRenamed({"spent": "target", "n": "target_n"}), "player", "season", []).drop("_hurt", "_days")


@query(
    "job_report",
    f"""WITH {RATINGS_SQL}, a AS (SELECT player, avg(rating) AS m, count(*) AS n FROM ratings WHERE season = 8 GROUP BY player), k AS (SELECT player, round(m, 6) AS mean, n, CAST(row_number() OVER (ORDER BY round(m, 6) DESC, player) AS INTEGER) AS place FROM a)
    SELECT player, mean, n, place FROM k WHERE place <= 10""",
)
def report(spark, d):
    """Job C, in short: the season's aggregates as an ordered top list."""
    a = aggs.player_season(ratings(spark, d).filter("season = 8"), ["player"], ["rating"], [])
    a = a.select("player", F.round("mean_rating", 6).alias("mean"), F.col("appearances").alias("n"))
    # Every task sends its ten best; only those are numbered.
    best = a.orderBy(F.col("mean").desc_nulls_last(), "player").limit(10).withColumn("all", F.lit(1))
    return ranking.top_k(best, ["all"], F.col("mean"), 10, ["player"]).drop("all")


@query(
    "job_identity",
    f"""WITH RECURSIVE {_WALK}, v AS (SELECT p_brand, short, "full", count(*) AS n FROM won GROUP BY ALL)
    SELECT p_brand, short, "full", n, CAST(count(*) OVER (PARTITION BY p_brand, short) AS BIGINT) AS n_values FROM v QUALIFY row_number() OVER (PARTITION BY p_brand, short ORDER BY n DESC, "full") = 1""",
)
def identity(spark, d):
    """Job D: names inside blocks, scored, assigned one to one, voted over the blocks of a brand."""
    won = names.greedy_match(_pairs(spark, d), ["p_brand", "p_type"], "short", "full", "score")
    return dedup.majority(won.withColumn("short", norm_name(F.col("short"))), ["p_brand", "short"], "full")


@query(
    "job_surprises",
    "SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN 0.0::DOUBLE WHEN p_partkey % 3 > 0 THEN p_size / 10.0::DOUBLE END AS signal, p_partkey % 6 > 0 AS has_input FROM part",
)
def surprises(spark, d):
    """The round report's signals: explicit facts first, the index only where experts have spoken."""
    k = F.col("p_partkey")
    signal = inference.starter_signal(F.when(k % 5 == 0, True), F.when(k % 3 > 0, F.col("p_size")))
    expert = F.when(k % 6 > 0, (F.col("p_size") % 11).cast("double"))
    p = t(spark, d, "part").select("p_partkey", F.when(k % 6 > 0, signal).alias("signal"), inference.rule_index(F.lit(15.0), expert).alias("idx"))
    return p.select("p_partkey", "signal", F.col("idx").isNotNull().alias("has_input"))
