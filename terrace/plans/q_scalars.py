"""Scalar functions (P) and sources (S) over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrace.functions import scalars as s
from terrace.plans.bindings import MATCHES_SQL, RATINGS_SQL, matches, ratings, sides, t
from terrace.plans.registry import query
from terrace.sources import tables as io

# Texts that need tolerance, made from the tables' own columns.
_MESSY = "CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 7 = 1 THEN 'n/a' WHEN p_partkey % 7 = 2 THEN NULL ELSE CAST(p_size AS VARCHAR) || '.5' END"


def _messy():
    k = F.col("p_partkey") % 7
    return F.when(k == 0, "").when(k == 1, "n/a").when(k == 2, None).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".5")))


@query("p1_to_float", f"SELECT p_partkey, TRY_CAST(NULLIF({_MESSY}, '') AS DOUBLE) AS x FROM part")
def p1(spark, d):
    return t(spark, d, "part").select("p_partkey", s.to_float(_messy()).alias("x"))


@query(
    "p2_booleans",
    """WITH e AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN '' WHEN event_type = 'error' THEN 'True' ELSE 'False' END AS b FROM events)
    SELECT event_id, CASE WHEN b IS NULL OR b = '' THEN NULL ELSE b = 'True' END AS three, CASE WHEN b = 'True' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS two FROM e""",
)
def p2(spark, d):
    k = F.col("event_id") % 5
    b = F.when(k == 0, None).when(k == 1, "").when(F.col("event_type") == "error", "True").otherwise("False")
    return t(spark, d, "events").select("event_id", b.alias("b")).select("event_id", s.to_bool3(F.col("b")).alias("three"), s.flag01(F.col("b")).alias("two"))


@query(
    "p3_number_it",
    r"""WITH p AS (SELECT p_partkey, 'ca. ' || CASE WHEN p_partkey % 4 = 0 THEN '-' ELSE '' END || CAST(p_size AS VARCHAR) || CASE WHEN p_partkey % 3 = 0 THEN ',75 EUR' WHEN p_partkey % 3 = 1 THEN '.25' ELSE ' EUR' END AS v FROM part)
    SELECT p_partkey, TRY_CAST(replace(NULLIF(regexp_extract(v, '-?\d+(?:[,.]\d+)?'), ''), ',', '.') AS DOUBLE) AS x FROM p""",
)
def p3(spark, d):
    k = F.col("p_partkey")
    v = F.concat(F.lit("ca. "), F.when(k % 4 == 0, "-").otherwise(""), F.col("p_size").cast("string"), F.when(k % 3 == 0, ",75 EUR").when(k % 3 == 1, ".25").otherwise(" EUR"))
    return t(spark, d, "part").select("p_partkey", s.parse_number_it(v).alias("x"))


@query(
    "p4_sentinel",
    """SELECT event_id, CASE WHEN v <> '55' THEN v END AS rating, CASE WHEN f <> '55' THEN f END AS bonus, v = '55' OR f = '55' AS unrated
    FROM (SELECT event_id, CAST(50 + event_id % 9 AS VARCHAR) AS v, CAST(50 + event_id % 7 AS VARCHAR) AS f FROM events)""",
)
def p4(spark, d):
    v, f = ((50 + F.col("event_id") % m).cast("string") for m in (9, 7))
    e = t(spark, d, "events").select("event_id", v.alias("v"), f.alias("f"))
    return e.select("event_id", s.sentinel_null(F.col("v")).alias("rating"), s.sentinel_null(F.col("f")).alias("bonus"), s.is_sentinel(F.col("v"), F.col("f")).alias("unrated"))


@query(
    "p5_price",
    """SELECT p_partkey, CASE WHEN v IN ('-', '', 'N.D.') THEN NULL ELSE TRY_CAST(replace(v, ',', '.') AS DOUBLE) END AS price FROM (
    SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '-' WHEN p_partkey % 5 = 1 THEN 'N.D.' WHEN p_partkey % 5 = 2 THEN '' ELSE CAST(p_size AS VARCHAR) || ',5' END AS v FROM part)""",
)
def p5(spark, d):
    k = F.col("p_partkey") % 5
    v = F.when(k == 0, "-").when(k == 1, "N.D.").when(k == 2, "").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(",5")))
    return t(spark, d, "part").select("p_partkey", s.parse_price(v).alias("price"))


@query("p6_map_values", "SELECT event_id, CASE event_type WHEN 'view' THEN 'Vista' WHEN 'click' THEN 'Clic' WHEN 'error' THEN 'Errore' ELSE event_type END AS label FROM events")
def p6(spark, d):
    return t(spark, d, "events").select("event_id", s.map_values(F.col("event_type"), {"view": "Vista", "click": "Clic", "error": "Errore"}).alias("label"))


@query(
    "p7_seasons",
    """WITH o AS (SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders), l AS (SELECT *, CAST(y AS VARCHAR) || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') AS label FROM o)
    SELECT o_orderkey, label, y AS start_year, CASE WHEN y BETWEEN 1996 AND 2000 THEN y - 1996 END AS idx,
      '20' || label[3:4] || '-' || label[6:7] AS from_short FROM l""",
)
def p7(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", s.season_label(F.year("o_orderdate")).alias("label"))
    short = F.concat(F.substring("label", 3, 2), F.lit("/"), F.substring("label", 6, 2))
    known = [f"{y}-{(y + 1) % 100:02d}" for y in range(1996, 2001)]
    return o.select("o_orderkey", "label", s.season_start_year(F.col("label")).alias("start_year"), s.season_index(F.col("label"), known).alias("idx"), s.season_from_short(short).alias("from_short"))


@query("p8_ids", r"SELECT page_id, COALESCE(NULLIF(regexp_extract(url, '/(\d+)$', 1), ''), NULLIF(regexp_extract(url, '/(\d+)[/?#]', 1), '')) AS id FROM pages")
def p8(spark, d):
    return t(spark, d, "pages").select("page_id", s.extract_id(F.col("url"), r"/(\d+)$", r"/(\d+)[/?#]").alias("id"))


@query(
    "p9_age",
    """SELECT o_orderkey, CAST(2010 - year(o_orderdate) - CASE WHEN (8, 1) < (month(o_orderdate), day(o_orderdate)) THEN 1 ELSE 0 END AS INTEGER) AS age,
    TRY_CAST(try_strptime(lpad(CAST(o_orderkey % 31 + 1 AS VARCHAR), 2, '0') || '/02/2020', '%d/%m/%Y') AS DATE) AS born FROM orders""",
)
def p9(spark, d):
    born = F.concat(F.lpad((F.col("o_orderkey") % 31 + 1).cast("string"), 2, "0"), F.lit("/02/2020"))
    return t(spark, d, "orders").select("o_orderkey", s.age_on(F.col("o_orderdate"), F.lit(2010)).alias("age"), s.day_it(born).alias("born"))


@query(
    "p10_heights",
    r"""SELECT p_partkey, TRY_CAST(replace(NULLIF(regexp_extract(h, '(\d+[,.]\d+)', 1), ''), ',', '.') AS DOUBLE) AS height, TRY_CAST(NULLIF(regexp_extract(g, '(\d+)', 1), '') AS INTEGER) AS days
    FROM (SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN '-' ELSE '1,' || CAST(60 + p_size % 40 AS VARCHAR) || ' m' END AS h, CASE WHEN p_partkey % 4 = 0 THEN '-' ELSE CAST(p_size AS VARCHAR) || ' giorni' END AS g FROM part)""",
)
def p10(spark, d):
    h = F.when(F.col("p_partkey") % 6 == 0, "-").otherwise(F.concat(F.lit("1,"), (60 + F.col("p_size") % 40).cast("string"), F.lit(" m")))
    g = F.when(F.col("p_partkey") % 4 == 0, "-").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(" giorni")))
    return t(spark, d, "part").select("p_partkey", s.parse_height(h).alias("height"), s.first_int(g).alias("days"))


@query("p11_day_of", "SELECT event_id, CAST(ts AS DATE) AS day FROM events")
def p11(spark, d):
    return t(spark, d, "events").select("event_id", s.day_of(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("day"))


@query("p12_norm_name", r"SELECT doc_id, trim(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS name FROM documents")
def p12(spark, d):
    return t(spark, d, "documents").select("doc_id", s.norm_name(F.col("text")).alias("name"))


@query(
    "p13_person",
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'D''' || upper(a[1]) || a[2:] || ' ' || upper(b[1]) || b[2:] WHEN p_partkey % 3 = 1 THEN upper(b[1]) || b[2:] ELSE upper(a[1]) || a[2:] END AS name
    FROM (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)""",
)
def p13(spark, d):
    k, a, b = F.col("p_partkey") % 3, F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    first, last = F.when(k == 0, F.concat(F.lit("D'"), F.upper(a))), F.when(k == 0, F.upper(b))
    return t(spark, d, "part").select("p_partkey", s.canonical_person(first, last, F.when(k == 1, b), a).alias("name"))


@query("p14_score", "SELECT event_id, CASE WHEN event_id % 6 <> 0 THEN CAST(event_id % 11 AS INTEGER) END AS score FROM events")
def p14(spark, d):
    v = F.when(F.col("event_id") % 6 == 0, " X").otherwise(F.concat(F.lit(" "), (F.col("event_id") % 11).cast("string")))
    return t(spark, d, "events").select("event_id", s.score_or_null(v).alias("score"))


@query("p15_opponent", f"WITH {MATCHES_SQL} SELECT match_id, CASE WHEN home < away THEN away ELSE home END AS other FROM matches")
def p15(spark, d):
    return matches(spark, d).select("match_id", s.opponent(F.least("home", "away"), F.col("home"), F.col("away")).alias("other"))


@query(
    "p16_two_sided",
    f"""WITH {MATCHES_SQL} SELECT match_id, home AS team, away AS opponent, true AS is_home, home_goals AS scored, away_goals AS conceded, CAST(CASE WHEN home_goals > away_goals THEN 3 WHEN home_goals = away_goals THEN 1 ELSE 0 END AS INTEGER) AS points FROM matches
    UNION ALL SELECT match_id, away, home, false, away_goals, home_goals, CAST(CASE WHEN away_goals > home_goals THEN 3 WHEN home_goals = away_goals THEN 1 ELSE 0 END AS INTEGER) FROM matches""",
)
def p16(spark, d):
    return sides(spark, d).select("match_id", "team", "opponent", "is_home", "scored", "conceded", "points")


@query("p17_clamp", "SELECT p_partkey, least(greatest(p_retailprice - 950, 0), 34.99) AS x, CASE WHEN p_partkey % 3 > 0 THEN greatest(CAST(p_size - 25 AS DOUBLE), 0) END AS n FROM part")
def p17(spark, d):
    n = F.when(F.col("p_partkey") % 3 > 0, (F.col("p_size") - 25).cast("double"))
    return t(spark, d, "part").select("p_partkey", s.clamp(F.col("p_retailprice") - 950, 0.0, 34.99).alias("x"), s.clamp(n, 0.0).alias("n"))


@query("p18_band", "SELECT p_partkey, CASE WHEN x >= 3 THEN 'up' WHEN x <= -3 THEN 'down' WHEN x IS NOT NULL THEN 'level' END AS band FROM (SELECT p_partkey, CASE WHEN p_partkey % 9 > 0 THEN p_size - 25 END AS x FROM part)")
def p18(spark, d):
    return t(spark, d, "part").select("p_partkey", s.band(F.when(F.col("p_partkey") % 9 > 0, F.col("p_size") - 25), 3, -3, ("up", "down", "level")).alias("band"))


@query("p19_in_set", "SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 490000) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS champion FROM customer")
def p19(spark, d):
    ref = t(spark, d, "orders").filter("o_totalprice > 490000").select(F.col("o_custkey").alias("c_custkey"))
    return s.in_set_flag(t(spark, d, "customer"), ref, ["c_custkey"], "champion").select("c_custkey", "champion")


@query("p20_select_base", "SELECT o_orderkey, o_orderdate, c_mktsegment AS buyer_c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def p20(spark, d):
    joined = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return s.select_base(joined, ["o_orderkey", "o_orderdate"], {"buyer_": ["c_mktsegment"]})


@query("s2_union_seasons", "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, NULL, c_mktsegment FROM customer")
def s2(spark, d):
    a = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    b = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return io.union_seasons([a, b])


@query("s4_append_new", "SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 60)")
def s4(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return io.append_new(e, e.filter("event_type = 'error' AND value > 60"), ["user_id"]).select("event_id", "user_id")


@query("s6_json_records", """SELECT '{"id":' || p_partkey || ',"name":"' || p_name || '","size":' || CASE WHEN p_partkey % 3 = 0 THEN 'null' ELSE CAST(p_size AS VARCHAR) END || '}' AS value FROM part""")
def s6(spark, d):
    cols = [F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_size")).alias("size")]
    return io.json_records(t(spark, d, "part"), cols, [F.col("p_partkey")])


@query("s7_nest", """SELECT p_partkey, '{"brand":"' || p_brand || '","size":' || p_size || '}' AS card, '{"name":"' || p_name || '"}' AS quant FROM part""")
def s7(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_name").alias("name"))
    n = io.nest(p, ["p_partkey"], {"card": ["brand", "size"], "quant": ["name"]})
    return n.select("p_partkey", F.to_json("card").alias("card"), F.to_json("quant").alias("quant"))


@query("s8_unpack_array", "SELECT p_partkey, p_name AS name, p_size AS size, CASE WHEN p_partkey % 4 > 0 THEN p_partkey END AS code FROM part")
def s8(spark, d):
    cells = F.array(F.col("p_name"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 4 == 0, "none").otherwise(F.col("p_partkey").cast("string")))
    rows = t(spark, d, "part").select("p_partkey", F.to_json(cells).alias("row"))
    return io.unpack_array(rows, "row", {"name": "string", "size": "int", "code": "bigint"}).drop("row")


@query("f1_valid_appearances", f"WITH {RATINGS_SQL} SELECT match_id, player, rating FROM ratings WHERE source = 'view' AND match_id % 10 <> 0 AND season BETWEEN 1 AND 8")
def f1(spark, d):
    from terrace.operators.guards import valid_appearances

    r = ratings(spark, d).withColumns({"unrated": F.when(F.col("match_id") % 10 == 0, "True").otherwise("False"), "season": F.when(F.col("season").between(1, 8), F.col("season"))})
    return valid_appearances(r, "source", "view", "unrated", ["rating"], "season").select("match_id", "player", "rating")


@query("f2_valid_matches", f"WITH {MATCHES_SQL} SELECT match_id, home_goals FROM matches WHERE home_goals <> 4 AND round <> 12")
def f2(spark, d):
    from terrace.operators.guards import valid_matches

    m = matches(spark, d).select("match_id", F.when(F.col("home_goals") < 4, F.col("home_goals")).alias("home_goals"), F.when(F.col("round") < 12, F.col("round")).alias("round"))
    return valid_matches(m, "home_goals", "round").select("match_id", "home_goals")


_SPLIT = "CASE WHEN season < 6 THEN 'train' WHEN season < 8 THEN 'val' WHEN season = 8 THEN 'test' END"


def split_ratings(spark, d):
    from terrace.operators.guards import temporal_split

    return temporal_split(ratings(spark, d), "season", list(range(6)), [6, 7], [8])


@query("f3_temporal_split", f"WITH {RATINGS_SQL} SELECT match_id, {_SPLIT} AS split FROM ratings")
def f3(spark, d):
    return split_ratings(spark, d).select("match_id", "split")


@query(
    "f4_qualify_keys",
    f"""WITH {RATINGS_SQL}, s AS (SELECT *, {_SPLIT} AS split FROM ratings), k AS (SELECT player FROM s GROUP BY player HAVING count(*) FILTER (WHERE split = 'train') >= 40 AND count(*) FILTER (WHERE split = 'test') >= 6)
    SELECT match_id, player, split FROM s WHERE player IN (SELECT player FROM k)""",
)
def f4(spark, d):
    from terrace.operators.guards import qualify_keys

    return qualify_keys(split_ratings(spark, d), "player", 40, 6).select("match_id", "player", "split")


@query("f5_f6_feature_contract", f"WITH {RATINGS_SQL} SELECT player, season, rating FROM ratings")
def f56(spark, d):
    from terrace.operators.guards import assert_feature_order, assert_no_leakage

    return assert_feature_order(assert_no_leakage(ratings(spark, d), {"goals", "final_score"}), ["player", "season", "rating"])


@query("f7_split_scorable", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = 2000) AS scorable FROM customer")
def f7(spark, d):
    from terrace.operators.guards import split_scorable

    c = t(spark, d, "customer").select("c_custkey")
    h = t(spark, d, "orders").filter(F.year("o_orderdate") == 2000).select(F.col("o_custkey").alias("c_custkey"))
    yes, no = split_scorable(c, h, "c_custkey")
    return yes.withColumn("scorable", F.lit(True)).unionByName(no.withColumn("scorable", F.lit(False)))
