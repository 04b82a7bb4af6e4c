"""Deduplication, joins, aggregations, windows and sets over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrace.functions.scalars import norm_name
from terrace.operators import aggs, dedup, incremental, joins, lags, names, ranking, sets, standings
from terrace.operators.rounds import settled, shared_path
from terrace.plans.bindings import MATCHES_SQL, RATINGS_SQL, SIDES_SQL, matches, ratings, sides, t
from terrace.plans.registry import SQL, query


def r6(c, name):
    return F.round(c, 6).alias(name)


@query("d1_keep_first", f"WITH {RATINGS_SQL} SELECT player, season, match_id, rating FROM ratings QUALIFY row_number() OVER (PARTITION BY player, season ORDER BY round, match_id) = 1")
def d1(spark, d):
    return dedup.keep_first(ratings(spark, d).select("player", "season", "round", "match_id", "rating"), ["player", "season"], ["round", "match_id"]).select("player", "season", "match_id", "rating")


@query("d2_keep_last", "SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS season, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def d2(spark, d):
    o = t(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("season"), "o_orderdate", "o_orderkey", "o_totalprice")
    return dedup.keep_last(o, ["o_custkey", "season"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


_VOTES = "v AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)"


@query("d3_majority", f"WITH {_VOTES} SELECT user_id, event_type, n, CAST(count(*) OVER (PARTITION BY user_id) AS BIGINT) AS n_values FROM v QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1")
def d3(spark, d):
    return dedup.majority(t(spark, d, "events"), ["user_id"], "event_type")


@query("d3_ambiguous", "SELECT count(*) FILTER (WHERE n > 1) AS ambiguous, count(*) AS keys FROM (SELECT o_custkey, o_orderdate, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY ALL)")
def d3b(spark, d):
    return dedup.ambiguous_keys(t(spark, d, "orders"), ["o_custkey", "o_orderdate"], "o_orderpriority")


@query("d4_invert_map", "SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name")
def d4(spark, d):
    return dedup.invert_map(t(spark, d, "part"), "p_partkey", "p_name", ["p_partkey"])


@query("d5_representative", f"WITH {RATINGS_SQL}, m AS (SELECT player, season, source, count(*) AS n FROM ratings GROUP BY ALL), b AS (SELECT player, season, source FROM m QUALIFY row_number() OVER (PARTITION BY player, season ORDER BY n DESC, source) = 1) SELECT player, season, b.source, l.match_id FROM b JOIN (SELECT player, season, arg_max(match_id, round * 1000000 + match_id) AS match_id FROM ratings GROUP BY ALL) l USING (player, season)")
def d5(spark, d):
    return dedup.representative(ratings(spark, d), ["player", "season"], "source", ["match_id"], ["round", "match_id"])


_NAMES = "CASE WHEN p_partkey % 3 = 0 THEN upper(p_name[1]) || p_name[2:] WHEN p_partkey % 3 = 1 THEN split_part(p_name, ' ', 1) || ' de ' || split_part(p_name, ' ', 2) ELSE p_name END"


def _names(spark, d):
    k, p = F.col("p_partkey") % 3, F.col("p_name")
    a, b = F.split_part(p, F.lit(" "), F.lit(1)), F.split_part(p, F.lit(" "), F.lit(2))
    n = F.when(k == 0, F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 100))).when(k == 1, F.concat_ws(" ", a, F.lit("de"), b)).otherwise(p)
    return t(spark, d, "part").select("p_partkey", "p_brand", "p_type", n.alias("name"))


@query("d6_canonical_names", f"WITH n AS (SELECT DISTINCT {_NAMES} AS name FROM part), k AS (SELECT name, split_part(lower(name), ' ', 1) AS a, split_part(lower(name), ' ', -1) AS b FROM n) SELECT name, first_value(name) OVER (PARTITION BY a, b ORDER BY length(name) DESC, name) AS canonical FROM k")
def d6(spark, d):
    n = _names(spark, d).withColumn("normal", norm_name(F.col("name")))
    return dedup.canonical_names(n, "name", "normal")


@query("j1_lookup_twice", f"WITH {MATCHES_SQL} SELECT match_id, h.s_name AS own_s_name, a.s_name AS opp_s_name FROM matches LEFT JOIN supplier h ON home = h.s_suppkey LEFT JOIN supplier a ON away = a.s_suppkey")
def j1(spark, d):
    dim = t(spark, d, "supplier")
    m = joins.lookup(matches(spark, d), dim, {"home": "s_suppkey"}, "own_", ["s_name"])
    return joins.lookup(m, dim, {"away": "s_suppkey"}, "opp_", ["s_name"]).select("match_id", "own_s_name", "opp_s_name")


@query("j2_bridge_join", "SELECT o_orderkey, CASE WHEN c_acctbal >= 0 THEN c_nationkey END AS c_nationkey, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey AND c_acctbal >= 0")
def j2(spark, d):
    # Customers in debt have no known nation.
    bridge = t(spark, d, "customer").withColumn("c_nationkey", F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey")))
    return joins.bridge_join(t(spark, d, "orders"), bridge, t(spark, d, "nation"), {"o_custkey": "c_custkey"}, "c_nationkey", {"c_nationkey": "n_nationkey"}, ["n_name"]).select("o_orderkey", "c_nationkey", "n_name")


@query(
    "j3_join_within_days",
    """WITH s AS (SELECT CAST(count(*) AS BIGINT) AS n FROM supplier), o AS (SELECT o_orderkey, o_custkey % n AS k, CAST(o_orderdate AS DATE) AS day FROM orders, s),
    r AS (SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS day, max(l_extendedprice) AS price FROM lineitem GROUP BY ALL)
    SELECT o_orderkey, CAST(CASE WHEN a.price IS NOT NULL THEN 0 WHEN b.price IS NOT NULL THEN 1 WHEN c.price IS NOT NULL THEN -1 END AS INTEGER) AS day_offset, coalesce(a.price, b.price, c.price) AS price
    FROM o LEFT JOIN r a ON a.k = o.k AND a.day = o.day LEFT JOIN r b ON b.k = o.k AND b.day = o.day + 1 LEFT JOIN r c ON c.k = o.k AND c.day = o.day - 1""",
)
def j3(spark, d):
    n = F.broadcast(t(spark, d, "supplier").agg(F.count("*").alias("n")))  # one row
    o = t(spark, d, "orders").join(n).select("o_orderkey", (F.col("o_custkey") % F.col("n")).alias("k"), F.to_date("o_orderdate").alias("day"))
    r = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.to_date("l_shipdate").alias("day"), F.col("l_extendedprice").alias("price"))
    return joins.join_within_days(o, r, ["k"], "day", ["price"], ["price"]).select("o_orderkey", "day_offset", "price")


_BLOCK = "p AS (SELECT p_brand, p_type, p_name, split_part(p_name, ' ', 2) AS short FROM part)"


def _pairs(spark, d):
    p = t(spark, d, "part").select("p_brand", "p_type", F.col("p_name").alias("full"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("short"))
    a, b = p.select("p_brand", "p_type", "short").distinct(), p.select("p_brand", "p_type", "full").distinct()
    return a.join(b, ["p_brand", "p_type"]).withColumn("score", names.name_score(F.col("short"), F.col("full"), 0.5)).filter("score is not null")


#: Pairs of a short and a full name inside a block with their score, and the walk over them by falling score: a step per
#: pair, with the names used so far.
_SCORED = f"""{_BLOCK}, a AS (SELECT DISTINCT p_brand, p_type, short FROM p), b AS (SELECT DISTINCT p_brand, p_type, p_name AS "full" FROM p), scored AS (SELECT p_brand, p_type, short, "full", CASE WHEN short = "full" THEN 3.0::DOUBLE WHEN list_contains(string_split("full", ' '), short) THEN 2.0::DOUBLE WHEN ends_with("full", short) THEN 1.0::DOUBLE WHEN contains("full", short) THEN 0.5::DOUBLE END AS score FROM a JOIN b USING (p_brand, p_type) WHERE contains("full", short))"""
_WALK = f"""{_SCORED}, steps AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY score DESC, short, "full") AS i FROM scored),
  walk AS (SELECT DISTINCT p_brand, p_type, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS a, CAST([] AS VARCHAR[]) AS b, false AS taken FROM scored
    UNION ALL SELECT p_brand, p_type, i, CASE WHEN free THEN list_append(a, short) ELSE a END, CASE WHEN free THEN list_append(b, "full") ELSE b END, free
    FROM (SELECT w.p_brand, w.p_type, s.i, w.a, w.b, s.short, s."full", NOT list_contains(w.a, s.short) AND NOT list_contains(w.b, s."full") AS free FROM walk w JOIN steps s ON s.p_brand = w.p_brand AND s.p_type = w.p_type AND s.i = w.i + 1)),
  won AS (SELECT s.p_brand, s.p_type, s.short, s."full", s.score FROM walk w JOIN steps s ON s.p_brand = w.p_brand AND s.p_type = w.p_type AND s.i = w.i WHERE w.taken)"""


@query("j4_name_score", f"WITH {_SCORED} SELECT * FROM scored")
def j4(spark, d):
    return _pairs(spark, d)


@query("j5_greedy_match", f"WITH RECURSIVE {_WALK} SELECT * FROM won")
def j5(spark, d):
    return names.greedy_match(_pairs(spark, d), ["p_brand", "p_type"], "short", "full", "score")


@query("j6_best_match", f"WITH {_BLOCK} SELECT p_brand, p_type, short, min(p_name) AS p_name, 2.0::DOUBLE AS score FROM p GROUP BY ALL")
def j6(spark, d):
    p = t(spark, d, "part").select("p_brand", "p_type", "p_name", F.split_part("p_name", F.lit(" "), F.lit(2)).alias("short"))
    variants = p.select("p_brand", "p_type", "short", F.explode(F.array("short", F.concat(F.lit("the "), F.col("short")))).alias("spelling")).distinct()
    roster = p.select("p_brand", "p_type", "p_name", F.col("p_name").alias("full")).distinct()
    return names.best_name_match(variants, roster, ["p_brand", "p_type"], "short", "spelling", "p_name", "full", 2.0, both_ways=True)


@query("j7_contains_match", f"WITH {_BLOCK} SELECT p_brand, p_type, short, min(p_name) AS p_name FROM p GROUP BY ALL")
def j7(spark, d):
    p = t(spark, d, "part").select("p_brand", "p_type", "p_name", F.split_part("p_name", F.lit(" "), F.lit(2)).alias("short"))
    return joins.contains_match(p.select("p_brand", "p_type", "short").distinct(), p.select("p_brand", "p_type", "p_name"), ["p_brand", "p_type"], "short", "short", "p_name", "p_name")


_FIX = "fixes AS (SELECT o_orderkey AS match_id, CAST(goals AS BIGINT) AS home_goals, CAST(NULL AS BIGINT) AS away_goals FROM (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey % 3 END AS goals FROM orders))"


def _fixes(spark, d):
    # A line for every order; those under way have no trusted value.
    goals = F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey") % 3)
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("match_id"), goals.alias("home_goals"), F.lit(None).cast("bigint").alias("away_goals"))


@query("j8_apply_corrections", f"WITH {MATCHES_SQL}, {_FIX} SELECT match_id, coalesce(f.home_goals, m.home_goals) AS home_goals, coalesce(f.away_goals, m.away_goals) AS away_goals FROM matches m LEFT JOIN fixes f USING (match_id)")
def j8(spark, d):
    return joins.apply_corrections(matches(spark, d), _fixes(spark, d), ["match_id"], ["home_goals", "away_goals"]).select("match_id", "home_goals", "away_goals")


@query("j8_change_list", f"WITH {MATCHES_SQL}, {_FIX} SELECT match_id, m.home_goals AS old_home_goals, f.home_goals AS new_home_goals FROM matches m JOIN fixes f USING (match_id) WHERE m.home_goals <> f.home_goals")
def j8b(spark, d):
    return joins.corrections(matches(spark, d), _fixes(spark, d), ["match_id"], ["home_goals"])


@query("j8_correct_partitions", f"WITH {MATCHES_SQL}, {_FIX} SELECT match_id, m.season, coalesce(f.home_goals, m.home_goals) AS home_goals, m.away_goals FROM matches m LEFT JOIN fixes f USING (match_id)")
def j8c(spark, d):
    """The corrections written into a stored table, a folder per season."""
    path = shared_path(spark, "corrected")
    matches(spark, d).select("match_id", "season", "home_goals", "away_goals").write.partitionBy("season").parquet(path)
    joins.correct_partitions(spark, path, _fixes(spark, d), ["match_id"], ["home_goals"], "season")
    return spark.read.parquet(path)


@query("j9_unmatched", "SELECT c_custkey FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey")
def j9(spark, d):
    big = t(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.unmatched(t(spark, d, "customer"), big, ["c_custkey"]).select("c_custkey")


_SPEND = "spend AS (SELECT o_custkey AS player, CAST(year(o_orderdate) AS INTEGER) AS season, round(sum(o_totalprice), 2) AS spent, round(avg(o_totalprice), 2) AS mean, count(*) AS n FROM orders GROUP BY ALL)"


def spend(spark, d):
    return t(spark, d, "orders").groupBy(F.col("o_custkey").alias("player"), F.year("o_orderdate").alias("season")).agg(F.round(F.sum("o_totalprice"), 2).alias("spent"), F.round(F.avg("o_totalprice"), 2).alias("mean"), F.count("*").alias("n"))


@query("j10_previous_season", f"WITH {_SPEND} SELECT a.player, a.season, a.n, b.n AS prev_n FROM spend a JOIN spend b ON a.player = b.player AND a.season = b.season + 1")
def j10(spark, d):
    return joins.with_previous_season(spend(spark, d).select("player", "season", "n"), "player", "season", ["n"])


@query("j11_lookup_if", "SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN c_mktsegment END AS new_c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def j11(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return joins.lookup_if(o, t(spark, d, "customer"), {"o_custkey": "c_custkey"}, F.col("o_totalprice") > 250000, "new_", ["c_mktsegment"]).select("o_orderkey", "new_c_mktsegment")


@query("j12_first_resolved", "WITH s AS (SELECT o_custkey AS player, o_orderkey, o_orderkey % 400 AS code FROM orders) SELECT player, first(s_name ORDER BY o_orderkey) AS s_name FROM s JOIN supplier ON code = s_suppkey GROUP BY player")
def j12(spark, d):
    s = t(spark, d, "orders").select(F.col("o_custkey").alias("player"), "o_orderkey", (F.col("o_orderkey") % 400).alias("code"))
    return joins.first_resolved(s, t(spark, d, "supplier").withColumnRenamed("s_suppkey", "code"), ["code"], ["player"], ["o_orderkey"], "s_name")


@query("j13_merge_sheet", "SELECT o_orderkey, o_custkey, s_suppkey, CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS s_acctbal FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN supplier ON s_suppkey = c_nationkey")
def j13(spark, d):
    report = t(spark, d, "orders").select("o_orderkey", "o_custkey")
    ids = t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("bigint").alias("id"))
    sheet = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), "s_suppkey", F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).alias("s_acctbal"))
    return joins.merge_sheet(report, ids, sheet, ["o_custkey"], "id", ["s_suppkey", "s_acctbal"]).drop("id")


@query("a1_player_season", f"WITH {RATINGS_SQL} SELECT player, season, round(avg(rating), 6) AS mean_rating, round(sum(CASE WHEN source = 'view' THEN rating ELSE 0 END), 4) AS sum_views, count(*) AS appearances FROM ratings GROUP BY ALL")
def a1(spark, d):
    r = ratings(spark, d).withColumn("views", F.when(F.col("source") == "view", F.col("rating")))
    return aggs.player_season(r, ["player", "season"], ["rating"], ["views"]).select("player", "season", r6(F.col("mean_rating"), "mean_rating"), F.round("sum_views", 4).alias("sum_views"), "appearances")


@query("a2_stat_season", f"WITH {RATINGS_SQL} SELECT player, season, round(sum(rating), 4) AS sum_rating, count(*) FILTER (WHERE source <> 'signup' OR match_id % 4 = 0) AS starts FROM ratings GROUP BY ALL")
def a2(spark, d):
    r = ratings(spark, d).withColumn("position", F.when(F.col("match_id") % 4 > 0, F.col("source")))
    return aggs.stat_season(r, ["player", "season"], ["rating"], "position", "signup").withColumn("sum_rating", F.round("sum_rating", 4))


@query("a3_by_side", "SELECT l_orderkey, round(sum(CASE WHEN l_linestatus = 'O' THEN l_discount ELSE 0 END), 6) AS xg_home, round(sum(CASE WHEN l_linestatus <> 'O' THEN l_discount ELSE 0 END), 6) AS xg_away FROM lineitem GROUP BY ALL")
def a3(spark, d):
    x = aggs.by_side(t(spark, d, "lineitem").withColumn("xg", F.col("l_discount")), ["l_orderkey"], "l_linestatus", "O", "xg")
    return x.select("l_orderkey", r6(F.col("xg_home"), "xg_home"), r6(F.col("xg_away"), "xg_away"))


_STAND = f"""WITH {SIDES_SQL}, per AS (SELECT season, round, team, sum(points) AS p, count(*) FILTER (WHERE points = 3) AS w, count(*) FILTER (WHERE points = 1) AS dr, count(*) FILTER (WHERE points = 0) AS l, sum(scored) AS gf, sum(conceded) AS ga FROM sides GROUP BY ALL),
  spine AS (SELECT * FROM (SELECT DISTINCT season, team FROM sides) JOIN (SELECT DISTINCT season, round FROM sides) USING (season)),
  run AS (SELECT season, round, team, {', '.join(f"CAST(coalesce(sum({a}) OVER q, 0) AS BIGINT) AS {b}" for a, b in (("p", "points"), ("w", "won"), ("dr", "drawn"), ("l", "lost"), ("gf", "scored"), ("ga", "conceded")))} FROM spine LEFT JOIN per USING (season, round, team) WINDOW q AS (PARTITION BY season, team ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  standing AS (SELECT *, scored - conceded AS difference, CAST(row_number() OVER (PARTITION BY season, round ORDER BY points DESC, scored - conceded DESC, scored DESC, team) AS INTEGER) AS position FROM run)"""


@query("w1_spine", f"WITH {SIDES_SQL} SELECT season, team, round FROM (SELECT DISTINCT season, team FROM sides) JOIN (SELECT DISTINCT season, round FROM sides) USING (season)")
def w1(spark, d):
    return standings.team_round_spine(sides(spark, d)).select("season", "team", "round")


@query("w2_w3_standings_before", _STAND + " SELECT * FROM standing")
def w2(spark, d):
    return standings.standings_before(sides(spark, d))


@query("a4_final_standing", _STAND + " SELECT * FROM standing QUALIFY round = max(round) OVER (PARTITION BY season, team)")
def a4(spark, d):
    return aggs.final_standing(standings.standings_before(sides(spark, d)), ["season", "team"], "round")


@query(
    "w4_rolling_form",
    f"""WITH {SIDES_SQL}, spine AS (SELECT * FROM (SELECT DISTINCT season, team FROM sides) JOIN (SELECT DISTINCT season, round FROM sides) USING (season)),
    n AS (SELECT *, row_number() OVER (PARTITION BY season, team ORDER BY round DESC, match_id DESC) AS back FROM sides),
    p AS (SELECT s.season, s.team, s.round, m.points, m.scored, row_number() OVER (PARTITION BY s.season, s.team, s.round ORDER BY m.round DESC, m.match_id DESC) AS k FROM spine s JOIN n m ON m.season = s.season AND m.team = s.team AND m.round < s.round)
    SELECT season, team, round, round(avg(points) FILTER (WHERE k <= 3), 6) AS form3_points, round(avg(scored) FILTER (WHERE k <= 3), 6) AS form3_scored, round(avg(points) FILTER (WHERE k <= 5), 6) AS form5_points, round(avg(scored) FILTER (WHERE k <= 5), 6) AS form5_scored,
      count(k) FILTER (WHERE k <= 3) AS form3_n, count(k) FILTER (WHERE k <= 5) AS form5_n FROM spine LEFT JOIN p USING (season, team, round) GROUP BY ALL""",
)
def w4(spark, d):
    f = standings.rolling_form(sides(spark, d), ["points", "scored"])
    return f.select("season", "team", "round", *[r6(F.col(f"form{w}_{v}"), f"form{w}_{v}") for w in (3, 5) for v in ("points", "scored")], "form3_n", "form5_n")


@query(
    "w5_w6_player_lags",
    f"""WITH {RATINGS_SQL} SELECT match_id, player, round(avg(rating) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS lag3, round(avg(rating) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS lag5, count(*) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS earlier
    FROM ratings WINDOW w AS (PARTITION BY player ORDER BY season, round, match_id)""",
)
def w5(spark, d):
    x = lags.player_lags(ratings(spark, d), "player", ["season", "round", "match_id"], {"lag3": ("rating", 3), "lag5": ("rating", 5)})
    return x.select("match_id", "player", r6(F.col("lag3"), "lag3"), r6(F.col("lag5"), "lag5"), "earlier")


@query("w5_w6_incremental", SQL["w5_w6_player_lags"])
def w5_rounds(spark, d):
    """The same lags, season by season: each reads the state after the one before, and its own rows."""
    r, done = ratings(spark, d), None
    order, specs = ["season", "round", "match_id"], {"lag3": ("rating", 3), "lag5": ("rating", 5)}
    state = incremental.no_state(r, ["player"], order, ["rating"])
    for season in sorted(x.season for x in r.select("season").distinct().collect()):
        rows, state = incremental.advance(state, r.filter(F.col("season") == season), ["player"], order, specs)
        # The season's features are a table of their own: left as plans, one task would sort the rows of all seasons.
        state, rows = settled(state), settled(rows)
        done = rows if done is None else done.unionByName(rows)
    return done.select("match_id", "player", r6(F.col("lag3"), "lag3"), r6(F.col("lag5"), "lag5"), "earlier")


@query(
    "w4_incremental",
    f"""WITH {SIDES_SQL}, last AS (SELECT season, max(round) AS round FROM sides GROUP BY season), p AS (SELECT s.*, row_number() OVER (PARTITION BY season, team ORDER BY s.round DESC, match_id DESC) AS k FROM sides s JOIN last USING (season) WHERE s.round < last.round)
    SELECT season, team, round(avg(points) FILTER (WHERE k <= 3), 6) AS form3_points, round(avg(points) FILTER (WHERE k <= 5), 6) AS form5_points, count(*) FILTER (WHERE k <= 3) AS form3_n, count(*) FILTER (WHERE k <= 5) AS form5_n FROM p GROUP BY ALL""",
)
def w4_rounds(spark, d):
    """Every team's form before the last round of its season, from states advanced round by round."""
    s = sides(spark, d).select("season", "round", "team", "match_id", "points")
    last = s.groupBy("season").agg(F.max("round").alias("_last"))
    s = settled(s.join(last, "season").filter("round < _last").drop("_last"))
    keys, order = ["season", "team"], ["round", "match_id"]
    state = incremental.no_state(s, keys, order, ["points"])
    for n in sorted(x.round for x in s.select("round").distinct().collect()):
        state = settled(incremental.advance_matches(state, s.filter(F.col("round") == n), keys, order, ["points"], 5))
    f = incremental.form(state, keys, ["points"])
    return f.select(*keys, *[r6(F.col(f"form{w}_points"), f"form{w}_points") for w in (3, 5)], "form3_n", "form5_n")


@query("a5_injury_features", f"WITH {RATINGS_SQL}, s AS (SELECT DISTINCT player, season FROM ratings), e AS (SELECT player, season AS es, rating FROM ratings WHERE source = 'error') SELECT player, season, count(es) FILTER (WHERE es = season - 1) AS injuries_prev, round(coalesce(sum(rating) FILTER (WHERE es = season - 1), 0), 4) AS days_prev, count(es) FILTER (WHERE es < season) AS injuries_career FROM s LEFT JOIN e USING (player) GROUP BY ALL")
def a5(spark, d):
    r = ratings(spark, d)
    return aggs.injury_features(r, r.filter("source = 'error'"), "player", "season", "rating").withColumn("days_prev", F.round("days_prev", 4))


@query("a6_rosters", "SELECT DISTINCT p_brand, p_type, p_name FROM part")
def a6(spark, d):
    return aggs.rosters(t(spark, d, "part"), ["p_brand", "p_type"], "p_name")


@query("a7_coverage", f"WITH {RATINGS_SQL} SELECT season, count(*) AS rows, count(CASE WHEN rating > 10 THEN 1 END) AS n_high, round(100.0 * count(CASE WHEN rating > 10 THEN 1 END) / count(*), 4) AS pct_high FROM ratings GROUP BY season")
def a7(spark, d):
    return aggs.coverage(ratings(spark, d).withColumn("high", F.when(F.col("rating") > 10, 1)), ["season"], ["high"])


_PRED = f"WITH {RATINGS_SQL}, p AS (SELECT *, avg(rating) OVER (PARTITION BY player ORDER BY round, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS pred FROM ratings), q AS (SELECT * FROM p WHERE pred IS NOT NULL)"


def _predicted(spark, d):
    return lags.player_lags(ratings(spark, d), "player", ["round", "match_id"], {"pred": ("rating", 5)})


@query("a8_regression_metrics", _PRED + " SELECT season, round(avg(abs(rating - pred)), 6) AS mae, round(sqrt(avg((rating - pred) ** 2)), 6) AS rmse, round(1 - sum((rating - pred) ** 2) / (var_pop(rating) * count(*)), 6) AS r2, count(*) AS n FROM q GROUP BY season")
def a8(spark, d):
    m = aggs.regression_metrics(_predicted(spark, d), "rating", "pred", ["season"])
    return m.select("season", *[r6(F.col(c), c) for c in ("mae", "rmse", "r2")], "n")


@query("a9_bias_report", _PRED + ", b AS (SELECT player, round(avg(pred - rating), 6) AS bias, count(*) AS n FROM q GROUP BY player HAVING count(*) >= 30) SELECT * FROM (SELECT *, 'low' AS \"end\" FROM b ORDER BY bias, player LIMIT 5) UNION ALL SELECT * FROM (SELECT *, 'high' AS \"end\" FROM b ORDER BY bias DESC, player LIMIT 5)")
def a9(spark, d):
    return aggs.bias_report(_predicted(spark, d).filter("pred is not null"), "player", "rating", "pred")


@query("a10_median_impute", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN (SELECT median(CAST(p_size AS DOUBLE)) FROM part WHERE p_partkey % 4 > 0 AND p_partkey % 10 < 8) ELSE CAST(p_size AS DOUBLE) END AS size FROM part")
def a10(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 > 0, F.col("p_size").cast("double")).alias("size"))
    return aggs.median_impute(p, ["size"], F.col("p_partkey") % 10 < 8)


@query("a11_compare_models", _PRED + ", k AS (SELECT player, avg(abs(rating - pred)) AS a, avg(abs(rating - 12)) AS b, count(*) AS n FROM q GROUP BY player) SELECT round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(sum(a * n) / sum(n), 6) AS weighted_a, round(sum(b * n) / sum(n), 6) AS weighted_b, round(avg(CAST(a < b AS INTEGER)), 6) AS share_a, count(*) AS keys, CASE WHEN sum(a * n) < sum(b * n) THEN 'a' ELSE 'b' END AS verdict FROM k")
def a11(spark, d):
    p = _predicted(spark, d).filter("pred is not null")
    k = p.groupBy("player").agg(F.avg(F.abs(F.col("rating") - F.col("pred"))).alias("a"), F.avg(F.abs(F.col("rating") - 12)).alias("b"), F.count("*").alias("n"))
    out = aggs.compare_models(k, "a", "b", "n")
    return out.select(*[r6(F.col(c), c) for c in ("mean_a", "mean_b", "weighted_a", "weighted_b", "share_a")], "keys", "verdict")


@query("a12_profile", "SELECT count(*) AS rows, count(DISTINCT user_id) AS distinct_user_id, count(DISTINCT event_type) AS distinct_event_type, count(*) FILTER (WHERE value > 50) AS high FROM events")
def a12(spark, d):
    return aggs.profile(t(spark, d, "events"), ["user_id", "event_type"], {"high": F.col("value") > 50})


@query(
    "a12_profile_sketches",
    f"WITH {RATINGS_SQL} SELECT count(*) AS rows, count(*) FILTER (WHERE rating > 50) AS high, count(player) AS n_player, round(100.0 * count(player) / count(*), 4) AS pct_player, true AS players_within, true AS sources_within FROM ratings",
)
def a12_sketches(spark, d):
    """The report over all seasons from one stored row each. Estimates stand beside exact numbers: within three standard
    errors."""
    r = ratings(spark, d)
    path = shared_path(spark, "profiles")
    seasons = aggs.profile_sketches(r, ["season"], ["player", "source"], {"high": F.col("rating") > 50}, ["player"])
    seasons.write.partitionBy("season").parquet(path)
    report = aggs.merged_profile(spark.read.parquet(path), [], ["player", "source"], ["high"], ["player"])
    exact = F.broadcast(r.agg(F.count_distinct("player").alias("players"), F.count_distinct("source").alias("sources")))  # one row
    within = lambda c, n: (F.abs(F.col(c) - F.col(n)) <= 3 * 1.04 / 64 * F.col(n))
    return report.join(exact).select("rows", "high", "n_player", "pct_player", within("distinct_player", "players").alias("players_within"), within("distinct_source", "sources").alias("sources_within"))


@query(
    "w7_w11_season_features",
    f"""WITH {_SPEND}, y AS (SELECT player, season, CASE WHEN (player + season) % 5 > 0 THEN spent END AS spent FROM spend), x AS (SELECT player, season, spent, lag(season) OVER o AS ps, lag(spent) OVER o AS pv, avg(spent) OVER n AS m3, stddev_pop(spent) OVER n AS s3, count(spent) OVER n AS k3, first_value(spent IGNORE NULLS) OVER n AS f3, last_value(spent IGNORE NULLS) OVER n AS l3, avg(spent) OVER f AS ca, count(*) OVER f AS kf
      FROM y WINDOW o AS (PARTITION BY player ORDER BY season), n AS (PARTITION BY player ORDER BY season RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING), f AS (PARTITION BY player ORDER BY season RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT player, season, CASE WHEN ps = season - 1 THEN pv END AS spent_lag1, round(m3, 4) AS spent_mean, CASE WHEN k3 >= 2 THEN round(s3, 4) END AS spent_std, CASE WHEN k3 >= 2 THEN round((l3 - f3) / (k3 - 1), 4) END AS spent_trend, round(ca, 4) AS spent_career, kf AS earlier_seasons FROM x""",
)
def w7(spark, d):
    # Some seasons have no value.
    y = spend(spark, d).withColumn("spent", F.when((F.col("player") + F.col("season")) % 5 > 0, F.col("spent")))
    f = lags.season_features(y, "player", "season", ["spent"])
    return f.select("player", "season", "spent_lag1", *[F.round(f"spent_{k}", 4).alias(f"spent_{k}") for k in ("mean", "std", "trend", "career")], "earlier_seasons")


@query(
    "w12_rank_divergence",
    """WITH r AS (SELECT p_partkey, p_type, CAST(row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS INTEGER) AS rank_a, CAST(row_number() OVER (PARTITION BY p_type ORDER BY p_size DESC, p_partkey) AS INTEGER) AS rank_b FROM part),
    z AS (SELECT *, rank_a - rank_b AS divergence, (rank_a - rank_b) / stddev_pop(rank_a - rank_b) OVER (PARTITION BY p_type) AS zz FROM r)
    SELECT p_partkey, p_type, rank_a, rank_b, divergence, round(zz, 6) AS z, CASE WHEN zz >= 1 THEN 'undervalued' WHEN zz <= -1 THEN 'overvalued' ELSE 'aligned' END AS verdict FROM z""",
)
def w12(spark, d):
    p = t(spark, d, "part").select("p_partkey", "p_type", "p_retailprice", "p_size")
    return ranking.rank_divergence(p, "p_type", "p_retailprice", "p_size", ["p_partkey"]).select("p_partkey", "p_type", "rank_a", "rank_b", "divergence", r6(F.col("z"), "z"), "verdict")


@query("w13_top_k", "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS place FROM orders QUALIFY place <= 3")
def w13(spark, d):
    return ranking.top_k(t(spark, d, "orders"), ["o_custkey"], F.col("o_totalprice"), 3, ["o_orderkey"]).select("o_custkey", "o_orderkey", "place")


@query("w13_report_order", "SELECT p_brand, p_name, p_partkey, p_retailprice FROM part ORDER BY p_brand, p_retailprice DESC, p_name")
def w13b(spark, d):
    return ranking.report_order(t(spark, d, "part").select("p_brand", "p_name", "p_partkey", "p_retailprice"), "p_brand", "p_retailprice", "p_name")


@query("u1_union_by_name", "SELECT s_suppkey AS id, s_nationkey AS nation, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def u1(spark, d):
    a = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))
    b = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    return sets.union_by_name(a, b)


@query("u2_key_difference", "WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 0), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 300000) SELECT k, 'left' AS side FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'right' FROM b WHERE k NOT IN (SELECT k FROM a)")
def u2(spark, d):
    # Customers in credit against customers with a large order.
    a = t(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return sets.key_difference(a, t(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("k")), ["k"])


@query("u3_restrict_to_keys", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def u3(spark, d):
    keys = t(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return sets.restrict_to_keys(t(spark, d, "orders").select("o_orderkey", "o_custkey"), keys, ["o_custkey"])
