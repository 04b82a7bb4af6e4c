"""Text blocks (T), inference and models (M) over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrace.functions import text_blocks as tb
from terrace.operators import aggs, inference, models, sheets
from terrace.operators.rounds import dealt, shared_path
from terrace.plans.bindings import RATINGS_SQL, ratings, t
from terrace.plans.q_scalars import _SPLIT, split_ratings
from terrace.plans.registry import query


_SIDE = "o_orderkey, CASE WHEN l_linestatus = 'O' THEN 'h' ELSE 'a' END AS side, CAST(l_partkey AS VARCHAR) AS player"


@query(
    "t1_match_json",
    f"SELECT 'shot' AS kind, {_SIDE}, l_quantity AS minutes FROM orders JOIN lineitem ON o_orderkey = l_orderkey UNION ALL SELECT 'player', {_SIDE}, l_quantity + 1 FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
)
def t1(spark, d):
    # A nested text per match, as a source would store it: per side a list of shots, and a map of players by number.
    li = dealt(t(spark, d, "lineitem"), "l_orderkey").withColumn("side", F.when(F.col("l_linestatus") == "O", "h").otherwise("a"))
    entry = lambda minutes: F.struct(F.col("l_partkey").cast("string").alias("player"), minutes.alias("minutes"))
    shots = F.collect_list(entry(F.col("l_quantity"))).alias("shots")
    numbered = lambda arr: F.map_from_entries(F.transform(arr, lambda e, i: F.struct(i.cast("string"), e)))
    players = numbered(F.collect_list(entry(F.col("l_quantity") + 1))).alias("players")
    of_sides = lambda c: F.map_from_entries(F.collect_list(F.struct("side", c)))
    per = li.groupBy("l_orderkey", "side").agg(shots, players).groupBy("l_orderkey").agg(of_sides("shots").alias("shots"), of_sides("players").alias("rosters"))
    raw = per.join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", F.to_json(F.struct("shots", "rosters")).alias("json"))
    schema = "shots map<string,array<struct<player:string,minutes:double>>>, rosters map<string,map<string,struct<player:string,minutes:double>>>"
    rows, taken = tb.explode_match_json(raw, "json", schema, "rosters", "shots", ["o_orderkey"])
    return taken.withColumn("kind", F.lit("shot")).unionByName(rows.withColumn("kind", F.lit("player")))


@query("t2_stats_to_columns", "SELECT user_id, max_by(value, event_id) FILTER (WHERE event_type = 'click') AS stat__click, max_by(value, event_id) FILTER (WHERE event_type = 'view') AS stat__view, CAST(NULL AS DOUBLE) AS stat__other FROM events GROUP BY user_id")
def t2(spark, d):
    e = t(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type", "value"))).alias("stats"))
    return tb.stats_to_columns(e, "stats", "event_type", "value", ["click", "view", "other"]).drop("stats")


@query("t3_first_by_label", "SELECT user_id, min_by(event_id, event_id) FILTER (WHERE event_type = 'error') AS event_id FROM events GROUP BY user_id")
def t3(spark, d):
    e = t(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.concat(F.lit(" "), F.upper("event_type"), F.lit(" ")).alias("role")))).alias("staff"))
    return e.select("user_id", tb.first_by_label(F.col("staff"), "role", "Error")["event_id"].alias("event_id"))


#: The entities that the test pages hold; the ampersand comes last, so nothing is decoded twice.
_ENTITIES = {"&copy;": "©", "&middot;": "·", "&quot;": '"', "&amp;": "&", "&amp": "&"}


def _t4_sql() -> str:
    t = "regexp_replace(html, '<[^>]*>', ' ', 'g')"
    for entity, char in _ENTITIES.items():
        t = f"replace({t}, '{entity}', '{char}')"
    return rf"SELECT page_id, trim(regexp_replace({t}, '[ \t\n\x0b\f\r]+', ' ', 'g')) AS text FROM pages"


@query("t4_html_to_text", _t4_sql())
def t4(spark, d):
    return t(spark, d, "pages").select("page_id", tb.html_to_text(F.col("html")).alias("text"))


@query("t4_tags_to_blanks", r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\n\x0b\f\r]+', ' ', 'g')) AS text FROM pages")
def t4b(spark, d):
    return t(spark, d, "pages").select("page_id", tb.html_to_text(F.col("html"), entities=False).alias("text"))


@query("t5_extract_blocks", r"""SELECT page_id, CAST(i - 1 AS INTEGER) AS place, h[i] AS href, l[i] AS label FROM (SELECT page_id, h, l, unnest(range(1, len(h) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS h, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS l FROM pages))""")
def t5(spark, d):
    return tb.extract_blocks(t(spark, d, "pages"), "html", r'<a href="([^"]*)">([^<]*)</a>', ["href", "label"], ["page_id"])


@query("t6_sections", r"""SELECT page_id, CAST(i - 1 AS INTEGER) AS place, n[i] AS name, trim(b[i + 1]) AS body FROM (SELECT page_id, n, b, unnest(range(1, len(n) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<(nav|article|footer|p)>', 1) AS n, string_split_regex(html, '<(?:nav|article|footer|p)>') AS b FROM pages))""")
def t6(spark, d):
    return tb.sections(t(spark, d, "pages"), "html", "<(nav|article|footer|p)>", ["page_id"])


@query("t7_pct_pairs", "SELECT p_partkey, split_part(p_name, ' ', 1) AS name, CAST(p_size AS INTEGER) AS pct FROM part UNION ALL SELECT p_partkey, split_part(p_name, ' ', 2), CAST(100 - p_size AS INTEGER) FROM part")
def t7(spark, d):
    a, b = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    text = F.concat(a, F.lit(" ["), F.col("p_size").cast("string"), F.lit("%] - "), b, F.lit(" ["), (100 - F.col("p_size")).cast("string"), F.lit("%]"))
    return tb.pct_pairs(t(spark, d, "part").withColumn("text", text), "text", ["p_partkey"])


@query("t8_split_names", "SELECT p_partkey, unnest([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)]) AS name FROM part WHERE p_partkey % 4 > 0")
def t8(spark, d):
    text = F.when(F.col("p_partkey") % 4 == 0, "Assenti: nessuno").otherwise(F.concat(F.lit("assenti: "), F.replace("p_name", F.lit(" "), F.lit(" , "))))
    return tb.split_names(t(spark, d, "part").withColumn("text", text), "text", ["p_partkey"], "assenti")


@query("t9_pairs_to_map", "SELECT p_partkey, p_brand AS brand, CAST(p_size AS VARCHAR) AS size FROM part")
def t9(spark, d):
    text = F.concat(F.lit("Brand: | "), F.col("p_brand"), F.lit(" | Size: |"), F.col("p_size").cast("string"), F.lit("| rest"))
    m = t(spark, d, "part").select("p_partkey", tb.pairs_to_map(text, r"\|").alias("m"))
    return m.select("p_partkey", F.col("m")["Brand:"].alias("brand"), F.col("m")["Size:"].alias("size"))


@query("t10_table_rows", "SELECT l_orderkey, CAST(l_partkey AS VARCHAR) AS part, count(*) AS n FROM lineitem WHERE l_linenumber <= 4 GROUP BY ALL")
def t10(spark, d):
    # Each order's lines as a stored table; only rows of six cells and more count.
    cells = [F.col(c).cast("string") for c in ("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount")]
    row = F.concat(F.lit("<tr class='x'>"), *[F.concat(F.lit("<td><b>"), c, F.lit("</b></td>")) for c in cells], F.when(F.col("l_linenumber") <= 4, "<td>ok</td>").otherwise(""), F.lit("</tr>"))
    pages = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.concat_ws("\n", F.collect_list(row)).alias("html"))
    return tb.table_rows(pages, "html", ["l_orderkey"]).groupBy("l_orderkey", F.col("cells")[0].alias("part")).agg(F.count("*").alias("n"))


@query("t11_zip_sources", "SELECT p_partkey, 'fonte_0' AS source, CAST(p_size AS INTEGER) AS rating, p_retailprice AS score FROM part UNION ALL SELECT p_partkey, p_brand, CAST(NULL AS INTEGER), p_retailprice + 1 FROM part")
def t11(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.array("p_size", F.lit(None), F.lit(None)).alias("rating"), F.array(F.col("p_retailprice"), F.col("p_retailprice") + 1, F.lit(None)).alias("score"), F.array(F.lit(None), F.col("p_brand"), F.lit("empty")).alias("names"))
    return tb.zip_sources(p, ["rating", "score"], "names", ["p_partkey"])


_TO = "JOIN rated USING (p_brand, p_type) WHERE {on} GROUP BY p_brand, p_type, raw"


@query(
    "t12_assemble_sheet",
    f"""WITH rated AS (SELECT DISTINCT p_brand, p_type, p_name FROM part),
    c AS (SELECT p_brand, p_type, split_part(p_name, ' ', 2) AS raw, CAST(p_size * 2 AS INTEGER) AS pct FROM part WHERE p_size <= 25),
    u AS (SELECT p_brand, p_type, split_part(p_name, ' ', 1) AS raw, 'out ' || p_size AS reason FROM part WHERE p_size > 43),
    k AS (SELECT p_brand, p_type, p_name AS raw, CASE WHEN p_partkey % 2 = 0 THEN 'angoli' ELSE 'rigori' END AS set_piece FROM part WHERE p_retailprice < 1000),
    ch AS (SELECT p_brand, p_type, raw, min(p_name) AS p_name FROM c {_TO.format(on="list_contains(string_split(p_name, ' '), raw)")}),
    uh AS (SELECT p_brand, p_type, raw, min(p_name) AS p_name FROM u {_TO.format(on="contains(p_name, raw)")}),
    kh AS (SELECT p_brand, p_type, raw, min(p_name) AS p_name FROM k {_TO.format(on="contains(p_name, raw) OR contains(raw, p_name)")}),
    cs AS (SELECT p_brand, p_type, p_name, max(pct) AS pct FROM c JOIN ch USING (p_brand, p_type, raw) GROUP BY ALL),
    us AS (SELECT p_brand, p_type, p_name, min(reason) AS reason FROM u JOIN uh USING (p_brand, p_type, raw) GROUP BY ALL),
    ks AS (SELECT p_brand, p_type, p_name, min(set_piece) AS set_piece FROM k JOIN kh USING (p_brand, p_type, raw) GROUP BY ALL)
    SELECT p_brand, p_type, p_name, pct, pct >= 50 AS starter, reason IS NOT NULL AS unavailable, reason, set_piece IS NOT NULL AS kicks, set_piece
    FROM rated LEFT JOIN cs USING (p_brand, p_type, p_name) LEFT JOIN us USING (p_brand, p_type, p_name) LEFT JOIN ks USING (p_brand, p_type, p_name)""",
)
def t12(spark, d):
    p, block = t(spark, d, "part"), ["p_brand", "p_type"]
    word = lambda i: F.upper(F.split_part("p_name", F.lit(" "), F.lit(i))).alias("p_name")
    contests = p.filter("p_size <= 25").select(*block, word(2), (F.col("p_size") * 2).alias("pct"))
    out = p.filter("p_size > 43").select(*block, word(1), F.concat(F.lit("out "), F.col("p_size").cast("string")).alias("reason"))
    kick = p.filter("p_retailprice < 1000").select(*block, "p_name", F.when(F.col("p_partkey") % 2 == 0, "angoli").otherwise("rigori").alias("set_piece"))
    return sheets.assemble_sheet(p.select(*block, "p_name").distinct(), contests, out, kick, block, "p_name", 2.0)


@query("t13_bonus_columns", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS goals, 0.0::DOUBLE AS assists, p_partkey % 3 = 0 AS booked FROM part")
def t13(spark, d):
    bonus = F.array(F.struct(F.lit("Gol").alias("title"), F.lit("0").alias("value")), F.struct(F.lit("Gol").alias("title"), F.col("p_size").cast("string").alias("value")))
    cards = F.array(F.array(F.lit("rated")), F.array(F.when(F.col("p_partkey") % 3 == 0, "yellow").otherwise("plain"), F.lit("big")))
    p = t(spark, d, "part").select("p_partkey", bonus.alias("bonus"), cards.alias("cards"))
    return tb.bonus_columns(p, "bonus", {"goals": "Gol", "assists": "Assist"}, "cards", {"booked": "yellow"}).select("p_partkey", "goals", "assists", "booked")


_AR = f"""WITH {RATINGS_SQL}, s AS (SELECT *, {_SPLIT} AS split, lag(rating) OVER (PARTITION BY player ORDER BY season, round, match_id) AS l FROM ratings),
  c AS (SELECT player, regr_slope(rating, l) FILTER (WHERE split IN ('train', 'val')) AS b, regr_intercept(rating, l) FILTER (WHERE split IN ('train', 'val')) AS a FROM s GROUP BY player)"""


@query("m5_walk_forward_ar1", _AR + " SELECT match_id, player, round(a + b * l, 6) AS forecast FROM s JOIN c USING (player) WHERE split = 'test'")
def m5(spark, d):
    f = models.walk_forward_ar1(split_ratings(spark, d), "player", ["season", "round", "match_id"], "rating", F.col("split").isin("train", "val"))
    return f.filter("split = 'test'").select("match_id", "player", F.round("forecast", 6).alias("forecast"))


def _ar_sql(most: int = 3) -> str:
    """Least squares per player for every order up to ``most`` with a constant and one input: normal equations, one step of
    elimination per unknown, the order with the least AIC."""
    names = ["one", *[f"x{k}" for k in range(1, most + 1)], "click", "y"]
    sums = ", ".join(f"sum({a} * {b}) AS g_{a}_{b}" for i, a in enumerate(names) for b in names[i:])
    g = lambda a, b: f"g_{a}_{b}" if names.index(a) <= names.index(b) else f"g_{b}_{a}"
    steps, found = [], []
    for p in range(1, most + 1):
        use = [*names[: p + 1], "click"]
        m, target = len(use), "y"
        row = ", ".join([*(f"{g(a, b)} AS m{i}_{j}" for i, a in enumerate(use) for j, b in enumerate(use)), *(f"{g(a, 'y')} AS m{i}_{m}" for i, a in enumerate(use))])
        steps.append(f"e{p}_0 AS (SELECT player, {row} FROM sums WHERE g_one_one > {m + 1})")
        for k in range(m):
            rest = [f"m{i}_{j} - m{i}_{k} * m{k}_{j} / m{k}_{k} AS m{i}_{j}" if i != k else f"m{k}_{j} / m{k}_{k} AS m{k}_{j}" for i in range(m) for j in range(k + 1, m + 1)]
            steps.append(f"e{p}_{k + 1} AS (SELECT player, {', '.join(rest)} FROM e{p}_{k})")
        b = [f"m{i}_{m}" for i in range(m)]
        fit = " + ".join(f"{b[i]} * {b[j]} * {g(use[i], use[j])}" for i in range(m) for j in range(m))
        rss = f"g_y_y - 2 * ({' + '.join(f'{c} * {g(u, target)}' for c, u in zip(b, use, strict=True))}) + {fit}"
        cells = ", ".join(f"{c} AS c{i}" for i, c in enumerate([*b, *["NULL"] * (most + 2 - m)]))
        found.append(f"SELECT player, {p} AS p, CAST(g_one_one AS BIGINT) AS n, g_one_one * ln(({rss}) / g_one_one) + {2 * m} AS aic, {cells} FROM e{p}_{m} JOIN sums USING (player)")
    lags = ", ".join(f"lag(rating, {k}) OVER w AS x{k}" for k in range(1, most + 1))
    used = " AND ".join(f"x{k} IS NOT NULL" for k in range(1, most + 1))
    return f"""WITH {RATINGS_SQL}, s AS (SELECT match_id, player, {_SPLIT} AS split, 1.0::DOUBLE AS one, CAST(source = 'click' AS DOUBLE) AS click, rating AS y, {lags} FROM ratings WINDOW w AS (PARTITION BY player ORDER BY season, round, match_id)),
    sums AS (SELECT player, {sums} FROM s WHERE split IN ('train', 'val') AND {used} AND y IS NOT NULL AND click IS NOT NULL GROUP BY player), {', '.join(steps)},
    best AS (SELECT * FROM ({' UNION ALL '.join(found)}) QUALIFY row_number() OVER (PARTITION BY player ORDER BY aic, p) = 1)"""


def _click_ratings(spark, d):
    return split_ratings(spark, d).withColumn("click", (F.col("source") == "click").cast("double"))


@query("m5_ar_coefficients", _ar_sql() + f" SELECT player, CAST(p AS INTEGER) AS p, n, round(aic, 4) AS aic, {', '.join(f'round(c{i}, 5) AS c{i}' for i in range(5))} FROM best")
def m5b(spark, d):
    r = _click_ratings(spark, d).filter(F.col("split").isin("train", "val"))
    c = models.ar_coefficients(r, "player", ["season", "round", "match_id"], "rating", ["click"])
    return c.select("player", "p", "n", F.round("aic", 4).alias("aic"), *[F.round(F.get("coefficients", F.lit(i)), 5).alias(f"c{i}") for i in range(5)])


@query(
    "m5_walk_forward_ar",
    _ar_sql() + " SELECT match_id, player, CAST(p AS INTEGER) AS p, round(CASE p WHEN 1 THEN c0 + c1 * x1 + c2 * click WHEN 2 THEN c0 + c1 * x1 + c2 * x2 + c3 * click WHEN 3 THEN c0 + c1 * x1 + c2 * x2 + c3 * x3 + c4 * click END, 6) AS forecast FROM s LEFT JOIN best USING (player) WHERE split = 'test'",
)
def m5c(spark, d):
    f = models.walk_forward_ar(_click_ratings(spark, d), "player", ["season", "round", "match_id"], "rating", ["click"], F.col("split").isin("train", "val"))
    return f.filter("split = 'test'").select("match_id", "player", "p", F.round("forecast", 6).alias("forecast"))


@query(
    "m2_baselines",
    f"""WITH {RATINGS_SQL}, s AS (SELECT *, {_SPLIT} AS split, CAST(round AS DOUBLE) AS x, lag(rating) OVER w AS last, avg(rating) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS own FROM ratings WINDOW w AS (PARTITION BY player ORDER BY round, match_id)),
    c AS (SELECT avg(rating) AS m, regr_slope(rating, x) AS b, regr_intercept(rating, x) AS a FROM s WHERE split = 'train')
    SELECT match_id, round(m, 6) AS base_mean, round(coalesce(last, m), 6) AS base_last, round(coalesce(own, m), 6) AS base_own, round(a + b * x, 6) AS base_line FROM s, c""",
)
def m2(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("player").orderBy("round", "match_id")
    s = split_ratings(spark, d).withColumns({"x": F.col("round").cast("double"), "last": F.lag("rating").over(w), "own": F.avg("rating").over(w.rowsBetween(-5, -1))})
    out = models.baselines(s, "rating", "last", "own", "x", F.coalesce(F.col("split") == "train", F.lit(False)))
    return out.select("match_id", *[F.round(f"base_{k}", 6).alias(f"base_{k}") for k in ("mean", "last", "own", "line")])


#: Seven targets, as a season has them.
_TARGETS = {
    "y": "c_acctbal / 1000 + month + CASE WHEN urgent THEN 5 ELSE 0 END",
    "late": "month - c_acctbal / 2000",
    "early": "12 - month",
    "hurry": "CASE WHEN urgent THEN 3 ELSE 1 END * month",
    "wealth": "c_acctbal / 500",
    "half": "CASE WHEN month > 6 THEN 10 ELSE 1 END",
    "mixed": "abs(month - 6) + c_acctbal / 3000",
}
_MODEL_SQL = f"""WITH o AS (SELECT o_orderkey, c_acctbal, month(o_orderdate) AS month, o_orderpriority = '1-URGENT' AS urgent, year(o_orderdate) AS year FROM orders JOIN customer ON o_custkey = c_custkey),
  m AS (SELECT *, CASE WHEN year < 1999 THEN 'train' WHEN year = 1999 THEN 'val' ELSE 'test' END AS split, {', '.join(f'CAST({v} AS DOUBLE) AS "{k}"' for k, v in _TARGETS.items())} FROM o)"""


def _table(spark, d):
    o = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    y = F.year("o_orderdate")
    rows = o.select(
        "o_orderkey",
        "c_acctbal",
        F.month("o_orderdate").cast("double").alias("month"),
        F.col("o_orderpriority").alias("priority"),
        (F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
        F.when(y < 1999, "train").when(y == 1999, "val").otherwise("test").alias("split"),
        F.when(F.col("o_orderkey") % 9 > 0, F.col("c_acctbal")).alias("balance"),
    )
    return rows.select("*", *[F.expr(v).cast("double").alias(k) for k, v in _TARGETS.items()]).drop("c_acctbal", "urgent")


@query("m1_m4_trained_scores")
def m14(spark, d):
    """Boosted trees per target, then scores of the test rows with the column contract and clamped counts."""
    rows, features, cats = _table(spark, d), ["balance", "month", "priority"], ["priority"]
    made = models.train_targets(rows, list(_TARGETS), features, cats, max_iter=12, leaves=15)
    return models.score_targets(rows.filter("split = 'test'"), made, features, cats, {"y"}).select("o_orderkey", *[c for k in _TARGETS for c in (k, f"pred_{k}")])


@query(
    "m1_against_baselines",
    _MODEL_SQL + " " + " UNION ALL ".join(f"""SELECT '{k}' AS target, count(*) AS n, round(avg(abs("{k}" - (SELECT avg("{k}") FROM m WHERE split = 'train'))), 4) AS mae_mean, true AS trees_better FROM m WHERE split = 'test'""" for k in _TARGETS),
)
def m1_baselines(spark, d):
    """Every target's mean error on the test rows, beside that of the train mean, which trees must undercut."""
    rows, features, cats = _table(spark, d), ["balance", "month", "priority"], ["priority"]
    made = models.train_targets(rows, list(_TARGETS), features, cats, max_iter=12, leaves=15)
    means = F.broadcast(rows.filter("split = 'train'").agg(*[F.avg(k).alias(f"mean_{k}") for k in _TARGETS]))  # one row
    scored = models.score_targets(rows.filter("split = 'test'"), made, features, cats, digits=6).join(means)
    each = F.array(*[F.struct(F.lit(k).alias("target"), F.abs(F.col(k) - F.col(f"mean_{k}")).alias("base"), F.abs(F.col(k) - F.col(f"pred_{k}")).alias("own")) for k in _TARGETS])
    out = scored.select(F.inline(each)).groupBy("target").agg(F.count("*").alias("n"), F.avg("base").alias("base"), F.avg("own").alias("own"))
    return out.select("target", "n", F.round("base", 4).alias("mae_mean"), (F.col("own") < F.col("base")).alias("trees_better"))


@query("m4_stored_trees", _MODEL_SQL + " " + " UNION ALL ".join(f"""SELECT '{k}' AS target, count(*) AS n, true AS equal_scores, true AS not_negative FROM m WHERE split = 'test'""" for k in ("y", "early")))
def m4_stored(spark, d):
    """Scores from stored trees as expressions, beside those of the models: the same for every row."""
    rows, features, cats = _table(spark, d), ["balance", "month", "priority"], ["priority"]
    made = models.train_targets(rows, ["y", "early"], features, cats, max_iter=6, leaves=15)
    path, test = shared_path(spark, "trees"), rows.filter("split = 'test'").select("o_orderkey", *features)
    models.store_trees(made, path)
    own = models.score_targets(test, made, features, cats, {"y", "early"}, 6).select("o_orderkey", F.col("pred_y").alias("own_y"), F.col("pred_early").alias("own_early"))
    both = models.score_stored(test, path, ["y", "early"], features, cats, {"y", "early"}, 6).join(own, "o_orderkey")
    each = F.array(*[F.struct(F.lit(k).alias("target"), F.col(f"pred_{k}").alias("p"), F.col(f"own_{k}").alias("o")) for k in ("y", "early")])
    return both.select(F.inline(each)).groupBy("target").agg(F.count("*").alias("n"), F.bool_and(F.abs(F.col("p") - F.col("o")) <= 2e-6).alias("equal_scores"), (F.min("p") >= 0).alias("not_negative"))


@query("m3_importances")
def m3(spark, d):
    rows, features, cats = _table(spark, d), ["balance", "month", "priority"], ["priority"]
    made = models.train_targets(rows, ["y"], features, cats, max_iter=5, max_depth=4)
    return spark.createDataFrame(models.importances(made["y"], features, cats), "feature string, importance double")


_TRI = "greatest(0.0, least(1.0, {u}, {v}))"


def _mf(x, feet):
    a, b, c = feet
    up, down = "1.0" if a == b else f"({x} - {a}) / {b - a}.0", "1.0" if b == c else f"({c} - {x}) / {c - b}.0"
    return f"CASE WHEN {x} < {a} OR {x} > {c} THEN 0.0 ELSE {_TRI.format(u=up, v=down)} END"


def _m6_sql():
    p = {k: _mf("x1", v) for k, v in inference.STARTS.items()}
    q = {k: _mf("x2", v) for k, v in inference.EXPERTS.items()}
    fire = {o: "greatest(" + ", ".join(f"least({p[a]}, {q[b]})" for (a, b), to in inference.RULES.items() if to == o) + ")" for o in inference.INDEX}
    f = "greatest(" + ", ".join(f"least({o}, {_mf('g.x', v)})" for o, v in inference.INDEX.items()) + ")"
    # The distinct inputs are few; a grid of 20,001 points stands for the envelope.
    return f"""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, least(l_quantity * 0.7, 34.99) AS x1, round(l_discount * 100, 0) AS x2 FROM lineitem), i AS (SELECT DISTINCT x1, x2 FROM l),
    r AS (SELECT x1, x2, {', '.join(f'{v} AS {k}' for k, v in fire.items())} FROM i), g AS (SELECT range / 1000.0 - 10.0 AS x FROM range(20001)),
    e AS (SELECT x1, x2, CAST(g.x AS DOUBLE) AS x, CAST({f} AS DOUBLE) * CASE WHEN abs(g.x) = 10 THEN 0.5 ELSE 1.0 END AS f FROM r, g), c AS (SELECT x1, x2, round(sum(x * f) / nullif(sum(f), 0), 2) AS idx FROM e GROUP BY ALL)
    SELECT x1, x2, count(*) AS n, any_value(CAST(idx AS DOUBLE)) AS idx, any_value(CASE WHEN idx >= 3 THEN 'up' WHEN idx <= -3 THEN 'down' WHEN idx IS NOT NULL THEN 'level' END) AS band FROM l JOIN c USING (x1, x2) GROUP BY x1, x2"""


@query("m6_rule_index", _m6_sql())
def m6(spark, d):
    from terrace.functions.scalars import band, clamp

    li = t(spark, d, "lineitem").select(clamp(F.col("l_quantity") * 0.7, 0.0, inference.STARTS_TOP).alias("x1"), F.round(F.col("l_discount") * 100, 0).alias("x2"))
    # Equal inputs have equal results: count first, infer once per pair.
    pairs = li.groupBy("x1", "x2").agg(F.count("*").alias("n"))
    return pairs.withColumn("idx", F.round(inference.rule_index(F.col("x1"), F.col("x2")), 2)).withColumn("band", band(F.col("idx"), 3, -3, ("up", "down", "level")))


@query("m7_starter_signal", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 0.0::DOUBLE WHEN p_partkey % 3 > 0 THEN p_size / 10.0::DOUBLE END AS signal FROM part")
def m7(spark, d):
    k = F.col("p_partkey")
    return t(spark, d, "part").select("p_partkey", inference.starter_signal(F.when(k % 5 == 0, True), F.when(k % 3 > 0, F.col("p_size"))).alias("signal"))


@query("job_round_report", f"WITH {RATINGS_SQL}, a AS (SELECT player, season, avg(rating) AS m, count(*) AS n FROM ratings WHERE source = 'view' GROUP BY ALL) SELECT season, count(*) AS players, round(avg(m), 6) AS mean, CAST(sum(n) AS BIGINT) AS n FROM a GROUP BY season")
def report(spark, d):
    a = aggs.player_season(ratings(spark, d).filter("source = 'view'"), ["player", "season"], ["rating"], [])
    return a.groupBy("season").agg(F.count("*").alias("players"), F.round(F.avg("mean_rating"), 6).alias("mean"), F.sum("appearances").alias("n"))
