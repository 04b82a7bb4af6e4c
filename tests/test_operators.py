"""Edge cases on hand-made rows."""

import datetime as dt
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, DoubleType, IntegerType, StringType, StructField, StructType

from terrace.functions import scalars as s
from terrace.functions import text_blocks as tb
from terrace.operators import aggs, dedup, guards, inference, joins, lags, models, names, ranking, sheets, standings
from terrace.sources import tables as io


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "want"), [("1.5", 1.5), (" 7 ", 7.0), ("", None), ("1d", None), ("1_0", None), ("1e3", 1000.0), (None, None), ("abc", None)])
def test_to_float(spark, text, want):
    assert one(spark, s.to_float(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(
    ("name", "stroke", "want"), [("HØJLUND", True, "hojlund"), ("Højlund", False, "h jlund"), ("Ederson D.S.", False, "ederson d s"), ("José  Müller-Çelik", False, "jose muller celik"), (None, False, "")]
)
def test_norm_name(spark, name, stroke, want):
    assert one(spark, s.norm_name(F.lit(name).cast("string"), stroke)) == want


def test_person_title(spark):
    assert one(spark, s.title_name(F.lit("ROBERTO D'AVERSA"))) == "Roberto D'Aversa"
    assert one(spark, s.canonical_person(F.lit(None).cast("string"), F.lit(" "), F.lit("g. rossi"), F.lit("x"))) == "G. Rossi"


def test_clamp_keeps_null(spark):
    assert one(spark, s.clamp(F.lit(None).cast("double"), 0.0)) is None
    assert one(spark, s.clamp(F.lit(40.0), 0.0, 34.99)) == 34.99


def test_age_before_and_after_the_day(spark):
    assert one(spark, s.age_on(F.lit("2000-08-01").cast("date"), F.lit(2020))) == 20
    assert one(spark, s.age_on(F.lit("2000-08-02").cast("date"), F.lit(2020))) == 19
    assert one(spark, s.day_it(F.lit("31/02/2020"))) is None


def test_first_row_without_score_drops_the_match(spark):
    rows = spark.createDataFrame([(1, 0, None), (1, 1, 3), (2, 0, 2)], "m int, o int, goals int")
    kept = guards.valid_matches(dedup.keep_first(rows, ["m"], ["o"]), "goals")
    assert [(r.m, r.goals) for r in kept.collect()] == [(2, 2)]


def test_date_join_takes_exact_then_next_then_previous(spark):
    d = dt.date(2024, 1, 10)
    left = spark.createDataFrame([("a", d), ("b", d), ("c", d), ("e", d)], "k string, day date")
    day = dt.timedelta(days=1)
    right = spark.createDataFrame([("a", d, 1), ("a", d + day, 2), ("b", d + day, 3), ("b", d - day, 4), ("c", d - day, 5), ("c", d - day, 6)], "k string, day date, v int")
    got = {r.k: (r.day_offset, r.v) for r in joins.join_within_days(left, right, ["k"], "day", ["v"], ["v"]).collect()}
    assert got == {"a": (0, 1), "b": (1, 3), "c": (-1, 6), "e": (None, None)}


def matches(spark, rows):
    m = spark.createDataFrame(rows, "match_id int, season int, round int, home string, away string, hg int, ag int")
    return s.two_sided(m, ["match_id", "season", "round"], "home", "away", "hg", "ag")


ROWS = [(1, 1, 1, "A", "B", 2, 0), (2, 1, 2, "B", "A", 1, 1), (3, 1, 2, "A", "C", 0, 3), (4, 1, 3, "C", "B", 1, 0)]


def test_standings_start_at_zero_and_never_look_ahead(spark):
    before = standings.standings_before(matches(spark, ROWS))
    first = before.filter("round = 1").collect()
    assert {r.team for r in first} == {"A", "B", "C"} and all(r.points == r.scored == 0 for r in first)
    changed = [r if r[2] < 3 else (*r[:5], 9, 9) for r in ROWS]
    again = standings.standings_before(matches(spark, changed))
    key = lambda r: (r.round, r.team)
    assert sorted(before.collect(), key=key) == sorted(again.collect(), key=key)
    assert {r.team: r.points for r in before.filter("round = 3").collect()} == {"A": 4, "B": 1, "C": 3}


def test_form_with_two_matches_in_a_round_and_none(spark):
    f = {(r.round, r.team): r for r in standings.rolling_form(matches(spark, ROWS), ["points"]).collect()}
    assert f[(1, "A")].form3_points is None and f[(1, "A")].form3_n == 0
    assert f[(2, "A")].form3_points == 3.0 and f[(2, "A")].form3_n == 1  # not the other match of round 2
    assert f[(3, "A")].form3_points == pytest.approx(4 / 3) and f[(3, "A")].form3_n == 3
    assert f[(2, "C")].form3_n == 0


def test_lags_cross_seasons_and_count_to_five(spark):
    rows = [("p", 1 + i // 4, i, f"m{i}", float(i)) for i in range(8)] + [(None, 1, 1, "n", 1.0)]
    df = spark.createDataFrame(rows, "p string, season int, round int, m string, v double")
    got = {r.m: r for r in lags.player_lags(df, "p", ["season", "round", "m"], {"l3": ("v", 3)}).collect()}
    assert "n" not in got and got["m0"].l3 is None and got["m0"].earlier == 0
    assert got["m4"].l3 == 2.0 and got["m7"].earlier == 5
    free = {r.m: r.earlier for r in lags.player_lags(df, "p", ["season", "round", "m"], {}, None).collect()}
    assert free["m7"] == 7


def test_season_window_closes_gaps_in_the_trend(spark):
    df = spark.createDataFrame([("p", 6, 1.0), ("p", 8, 3.0), ("p", 9, 7.0), ("p", 10, 0.0)], "p string, season int, v double")
    r = {x.season: x for x in lags.season_features(df, "p", "season", ["v"]).collect()}
    assert r[10].v_mean == 5.0 and r[10].v_trend == 4.0 and r[10].v_std == 2.0 and r[10].v_lag1 == 7.0
    assert r[8].v_lag1 is None and r[8].v_mean == 1.0 and r[8].v_std is None and r[8].v_trend is None
    assert r[9].v_career == 2.0 and r[9].earlier_seasons == 2
    prev = joins.with_previous_season(df, "p", "season", ["v"]).collect()
    assert sorted((x.season, x.prev_v) for x in prev) == [(9, 3.0), (10, 7.0)]


def test_seasons_without_a_value_leave_the_trend(spark):
    df = spark.createDataFrame([("p", 1, 1.0), ("p", 2, None), ("p", 3, 3.0), ("p", 4, None), ("p", 5, 0.0), ("q", 1, None), ("q", 2, None)], "p string, season int, v double")
    r = {(x.p, x.season): x for x in lags.season_features(df, "p", "season", ["v"]).collect()}
    assert r["p", 4].v_trend == 2.0 and r["p", 4].v_mean == 2.0 and r["p", 4].earlier_seasons == 3
    assert r["p", 5].v_trend is None and r["p", 5].v_lag1 is None and r["q", 2].v_trend is None


def test_injuries_without_any_are_zero(spark):
    spine = spark.createDataFrame([("a", 3), ("b", 3)], "p string, season int")
    e = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 7.0), ("a", 3, 9.0)], "p string, season int, d double")
    got = {r.p: (r.injuries_prev, r.days_prev, r.injuries_career) for r in aggs.injury_features(spine, e, "p", "season", "d").collect()}
    assert got == {"a": (1, 7.0, 2), "b": (0, 0.0, 0)}


@pytest.mark.parametrize(
    ("short", "full", "want"),
    [("rossi", "rossi", 3.0), ("rossi", "paolo rossi", 2.0), ("paolo", "paolo rossi", 2.0), ("balogh n", "norbert balogh", 1.0), ("di maria", "angel di maria", 1.0), ("oss", "rossi", 0.5), ("bianchi", "rossi", None)],
)
def test_name_score(spark, short, full, want):
    assert one(spark, names.name_score(F.lit(short), F.lit(full), 0.5)) == want


def test_greedy_uses_each_side_once(spark):
    pairs = spark.createDataFrame([("k", "a", "x", 3.0), ("k", "b", "x", 3.0), ("k", "b", "y", 1.0), ("k", "a", "y", 2.0), ("l", "a", "x", 1.0)], "g string, a string, b string, score double")
    got = sorted((r.g, r.a, r.b) for r in names.greedy_match(pairs, ["g"], "a", "b", "score").collect())
    assert got == [("k", "a", "x"), ("k", "b", "y"), ("l", "a", "x")]


def test_canonical_coaches(spark):
    n = ["Cristian Chivu", "Cristian Eugen Chivu", "Filippo Inzaghi", "Simone Inzaghi"]
    df = spark.createDataFrame([(x,) for x in n], "name string").withColumn("normal", s.norm_name(F.col("name")))
    got = {r.name: r.canonical for r in dedup.canonical_names(df, "name", "normal").collect()}
    assert got == {n[0]: n[1], n[1]: n[1], n[2]: n[2], n[3]: n[3]}


@pytest.mark.parametrize(("x1", "x2", "want"), [(15.1, 9.0, 7.90), (22.7, 1.0, -7.84), (21.3, 6.0, -4.45), (35.0, 5.0, None), (10.0, None, None)])
def test_rule_index_golden(spark, x1, x2, want):
    got = one(spark, inference.rule_index(F.lit(x1), F.lit(x2).cast("double")))
    assert got is None if want is None else got == pytest.approx(want, abs=0.011)


@pytest.mark.parametrize(("x1", "x2", "sign"), [(2.0, 9.5, 1), (30.0, 1.0, -1), (28.0, 9.0, 0), (2.0, 1.0, 0)])
def test_rule_index_corners(spark, x1, x2, sign):
    got = one(spark, inference.rule_index(F.lit(x1), F.lit(x2)))
    assert (got >= 3) - (got <= -3) == sign and -10 <= got <= 10


def test_guards_raise(spark):
    df = spark.createDataFrame([(1, 2)], "a int, goals int")
    with pytest.raises(ValueError, match="goals"):
        guards.assert_no_leakage(df, {"goals"})
    with pytest.raises(ValueError, match="missing: b"):
        guards.assert_feature_order(df, ["a", "b"])


def test_divergence_of_a_constant_group_has_no_z(spark):
    df = spark.createDataFrame([(1, "d", 3.0, 3.0), (2, "d", 2.0, 2.0)], "id int, g string, a double, b double")
    assert [r.z for r in ranking.rank_divergence(df, "g", "a", "b", ["id"]).collect()] == [None, None]


def test_ranks_over_several_ranges(spark):
    # One group holds most rows, many of one value; one has no name.
    rows = [(i, None if i % 11 == 0 else "big" if i % 7 else "small", float(i * i % 5) if i % 9 else None, float(i * 31 % 17)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, g string, a double, b double").repartition(5)
    ranks = {}
    for name, at in (("rank_a", 2), ("rank_b", 3)):
        for g in {r[1] for r in rows}:
            inside = sorted((r for r in rows if r[1] == g), key=lambda r: (r[at] is None, -(r[at] or 0), r[0]))
            ranks |= {(name, r[0]): k for k, r in enumerate(inside, 1)}
    got = ranking.rank_divergence(df, "g", "a", "b", ["id"]).collect()
    assert {("rank_a", r.id): r.rank_a for r in got} | {("rank_b", r.id): r.rank_b for r in got} == ranks and len(got) == 400
    for g in (None, "big", "small"):
        d = [r.divergence for r in got if r.g == g]
        spread = statistics.pstdev(d)
        assert all(abs(r.z - r.divergence / spread) < 1e-9 for r in got if r.g == g)


@pytest.mark.parametrize("n", [0, 1, 2, 7, 200])
def test_medians_by_place(spark, n):
    rows = [(i, float(i * 37 % 23) if i % 3 else None, float(i % 2), None) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, x double, y double, z double").repartition(4)
    got = aggs.medians(df, ["x", "y", "z"], F.lit(True)).first()
    want = [statistics.median(v) if (v := [r[k] for r in rows if r[k] is not None]) else None for k in (1, 2, 3)]
    assert list(got) == want
    near = aggs.medians(df, ["x"], F.lit(True), accuracy=1_000).first().x
    values = sorted(r[1] for r in rows if r[1] is not None)
    assert near == (values[(len(values) - 1) // 2] if values else None)


def test_corrections_touch_two_columns_only(spark):
    m = spark.createDataFrame([(1, 0, 0, "x"), (2, 1, 1, "y")], "m int, h int, a int, t string")
    f = spark.createDataFrame([(1, 2, 0)], "m int, h int, a int")
    assert sorted(tuple(r) for r in joins.apply_corrections(m, f, ["m"], ["h", "a"]).collect()) == [(1, 2, 0, "x"), (2, 1, 1, "y")]
    assert [tuple(r) for r in joins.corrections(m, f, ["m"], ["h", "a"]).collect()] == [(1, 0, 2, 0, 0)]


def test_csv_and_optional(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,when,score,rated,n\n007,2024-05-01 20:45:00,6.5,True,3\n8,bad,x,,y\n")
    schema = StructType([StructField("id", StringType()), StructField("when", DateType()), StructField("score", DoubleType()), StructField("rated", BooleanType()), StructField("n", IntegerType())])
    got = [tuple(r) for r in io.read_table(spark, str(tmp_path / "t.csv"), schema).collect()]
    assert got == [("007", dt.date(2024, 5, 1), 6.5, True, 3), ("8", None, None, None, None)]
    assert io.read_optional(spark, str(tmp_path / "absent.csv"), schema).count() == 0


def test_writers_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "2023-24", None), (2, "2024-25", 1.5)], "id int, stagione string, x double")
    io.write_features(df, str(tmp_path / "f"), ["stagione"])
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "f")).filter("stagione = '2024-25'").collect()) == [2]
    io.export_json(df, str(tmp_path / "j"), [F.col("id"), F.col("x")], [F.col("id")])
    back = spark.read.schema("id int, x double").json(str(tmp_path / "j"))
    assert sorted((r.id, r.x) for r in back.collect()) == [(1, None), (2, 1.5)]


def test_nested_match_text(spark):
    text = '{"rosters":{"h":{"1":{"player":"A","minutes":90}},"a":{"2":{"player":"B","minutes":10}}},"shots":{"h":[{"player":"A","minutes":3}],"a":[]}}'
    schema = "rosters map<string,map<string,struct<player:string,minutes:double>>>, shots map<string,array<struct<player:string,minutes:double>>>"
    rows, shots = tb.explode_match_json(spark.createDataFrame([(5, text), (6, "broken")], "m int, j string"), "j", schema, "rosters", "shots", ["m"])
    assert sorted(tuple(r) for r in rows.collect()) == [(5, "a", "B", 10.0), (5, "h", "A", 90.0)]
    assert [tuple(r) for r in shots.collect()] == [(5, "h", "A", 3.0)]


def test_sheet_from_raw_names(spark):
    """Names as pages spell them: the best fit for contests, containment for the rest; other teams' names do not count."""
    rated = spark.createDataFrame([("A", "Rossi Mario"), ("A", "Bianchi Luca"), ("A", "Verdi"), ("B", "Rossi Paolo")], "team string, name string")
    contests = spark.createDataFrame([("A", "ROSSI", 60), ("A", "Bianchi L.", 40), ("A", "rossi mario", 55), ("A", "Neri", 90)], "team string, name string, pct int")
    out = spark.createDataFrame([("A", "verdi", "knee"), ("A", "Verdi", "ankle"), ("B", "Verdi", "hip")], "team string, name string, reason string")
    kick = spark.createDataFrame([("B", "Rossi", "rigori")], "team string, name string, set_piece string")
    got = {(r.team, r.name): tuple(r)[2:] for r in sheets.assemble_sheet(rated, contests, out, kick, ["team"], "name").collect()}
    assert got == {
        ("A", "Rossi Mario"): (60, True, False, None, False, None),
        ("A", "Bianchi Luca"): (40, False, False, None, False, None),
        ("A", "Verdi"): (None, None, True, "ankle", False, None),
        ("B", "Rossi Paolo"): (None, None, False, None, True, "rigori"),
    }
    none = sheets.assemble_sheet(rated, contests.limit(0), out.limit(0), kick.limit(0), ["team"], "name").collect()
    assert len(none) == 4 and not any(r.unavailable or r.kicks or r.pct for r in none)


def test_html_entities(spark):
    assert one(spark, tb.html_to_text(F.lit("<p>Caff&egrave;&nbsp;&amp; <b>t&#232;</b></p>"))) == "Caffè & tè"


def test_greedy_rounds_equal_the_walk(spark):
    rng = np.random.default_rng(4)
    rows = sorted({(f"g{g}", f"a{a}", f"b{b}", float(s)) for g, a, b, s in zip(rng.integers(0, 3, 300), rng.integers(0, 14, 300), rng.integers(0, 14, 300), rng.integers(0, 4, 300))})
    rows = list({(g, a, b): (g, a, b, s) for g, a, b, s in rows}.values())
    used, want = set(), set()
    for g, a, b, s in sorted(rows, key=lambda r: (-r[3], r[1], r[2])):
        if (g, "a", a) not in used and (g, "b", b) not in used:
            used |= {(g, "a", a), (g, "b", b)}
            want.add((g, a, b, s))
    pairs = spark.createDataFrame(rows, "g string, a string, b string, score double")
    assert {tuple(r) for r in names.greedy_match(pairs, ["g"], "a", "b", "score").collect()} == want
    assert names.greedy_match(pairs.limit(0), ["g"], "a", "b", "score").count() == 0


def test_autoregression_equals_least_squares(spark):
    """Orders and inputs against a plain solver: all orders on the rows that have the longest lag."""
    rng = np.random.default_rng(6)
    rows = []
    for k, c in (("one", (0.7, 0.0)), ("two", (0.2, 0.6))):
        y = [0.0, 0.5]
        z = rng.normal(size=120)
        for t in range(2, 120):
            y.append(0.3 + c[0] * y[-1] + c[1] * y[-2] + 0.8 * z[t] + rng.normal(0, 0.2))
        rows += [(k, t, float(y[t]), float(z[t])) for t in range(120)]
    df = spark.createDataFrame([*rows, ("short", 0, 1.0, 1.0), ("short", 1, 2.0, 1.0)], "k string, t int, y double, z double")
    got = {(r.k, r.t): r for r in models.walk_forward_ar(df, "k", ["t"], "y", ["z"], F.col("t") < 90).collect()}
    for k in ("one", "two"):
        y, z = (np.array([r[i] for r in rows if r[0] == k]) for i in (2, 3))
        at = np.arange(3, 90)
        best = None
        for p in (1, 2, 3):
            a = np.column_stack([np.ones(len(at)), *[y[at - j] for j in range(1, p + 1)], z[at]])
            b = np.linalg.lstsq(a, y[at], rcond=None)[0]
            aic = len(at) * np.log(((y[at] - a @ b) ** 2).mean()) + 2 * a.shape[1]
            best = min(best, (aic, p, b.tolist())) if best else (aic, p, b.tolist())
        _, p, b = best
        for t in range(90, 120):
            assert got[k, t].p == p and got[k, t].forecast == pytest.approx(b[0] + sum(b[j] * y[t - j] for j in range(1, p + 1)) + b[-1] * z[t], abs=1e-6)
    assert got["one", 0].forecast is None and got["short", 1].forecast is None


def test_ar_coefficients_recover_a_known_process(spark):
    rng = np.random.default_rng(0)
    y = [0.0]
    for _ in range(300):
        y.append(1 + 0.6 * y[-1] + rng.normal(0, 0.1))
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(y)] + [("short", 0, 1.0)], "k string, t int, y double")
    got = {r.k: r for r in models.ar_coefficients(df, "k", ["t"], "y", []).collect()}
    assert set(got) == {"k"} and got["k"].coefficients[1] == pytest.approx(0.6, abs=0.15)


def test_trees_beat_the_mean_and_repeat(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(a), None if i % 11 == 0 else float(b), "x" if a > 0 else "y", float(3 * (a > 0) + b), ["train", "train", "val", "test"][i % 4]) for i, (a, b) in enumerate(rng.normal(size=(600, 2)))]
    df = spark.createDataFrame(rows, "id int, a double, b double, c string, y double, split string")
    f, cats = ["a", "b", "c"], ["c"]
    runs = []
    for _ in range(2):
        m = models.train_targets(df, ["y"], f, cats, max_iter=8, max_depth=3)
        runs.append(models.score_targets(df.filter("split = 'test'"), m, f, cats, digits=6))
    a, b = ({r.id: r.pred_y for r in x.collect()} for x in runs)
    assert a == b
    e = runs[0].agg(F.avg(F.abs(F.col("y") - F.col("pred_y"))), F.avg(F.abs(F.col("y") - 1.5))).first()
    assert e[0] < e[1]
    assert [n for n, _ in models.importances(m["y"], f, cats)][0] in f
    few = models.train_targets(df, ["y"], f, cats, max_iter=4, min_leaf=1, leaves=6)["y"].stages[-1]
    assert max(t.numNodes for t in few.trees) <= 2 * 6 - 1 and few.getFeatureSubsetStrategy() == "0.85"


def test_partitions_follow_the_rows(spark, monkeypatch):
    from terrace.operators import rounds
    from terrace.plans import registry

    registry.load()
    monkeypatch.setattr(rounds, "ROWS", 100)
    assert rounds.dealt(spark.range(2001), "id").rdd.getNumPartitions() == 21
    assert rounds.dealt(spark.range(3), "id").rdd.getNumPartitions() == 8
    n = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    plan = registry.QUERIES["t1_match_json"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_orderkey" in plan and f", {-(-n // 100)})" in plan


def test_an_input_that_never_changes_has_no_fit(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(k, t, float(rng.normal()), float(t % 3 == 0 and k == 1)) for k in (1, 2) for t in range(30)], "k int, t int, y double, z double")
    got = {r.k: r for r in models.ar_coefficients(df, "k", ["t"], "y", ["z"]).collect()}
    assert np.isfinite(got[1].coefficients).all() and np.isfinite(got[1].aic)
    assert got[2].p == 1 and np.isnan(got[2].aic) and np.isnan(got[2].coefficients).all()
