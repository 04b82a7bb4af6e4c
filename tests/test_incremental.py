"""Round by round against the whole history; sketches; one pass over pages."""

import random

import pytest
from pyspark.sql import functions as F

from terrace.functions import text_blocks as tb
from terrace.operators import aggs, incremental, joins, lags, ranking, standings
from terrace.operators.rounds import settled


def some_rows():
    rng = random.Random(2)
    return [(rng.randrange(12) or None, rng.randrange(1, 7), m, rng.choice([None, 1.0, 2.5, 4.0])) for m in range(300)]


def test_lags_by_round_equal_the_whole(spark):
    df = settled(spark.createDataFrame(some_rows(), "player int, round int, match int, v double"))
    specs = {"lag2": ("v", 2), "lag4": ("v", 4)}
    for cap in (3, None):
        state, got = incremental.no_state(df, ["player"], ["round", "match"], ["v"]), []
        for n in (1, 2, 4, 6):  # rounds 3 and 5 come with the next
            rows, state = incremental.advance(state, df.filter((F.col("round") <= n) & (F.col("round") > {1: 0, 2: 1, 4: 2, 6: 4}[n])), ["player"], ["round", "match"], specs, cap)
            state = settled(state)
            got += rows.collect()
        want = lags.player_lags(df, "player", ["round", "match"], specs, cap)
        assert sorted(map(tuple, got)) == sorted(map(tuple, want.select(*got[0].__fields__).collect()))
        kept = state.collect()
        assert all(len(r.recent) <= 4 for r in kept) and sum(r.seen for r in kept) == want.count()


def test_a_late_row_is_an_error(spark):
    df = spark.createDataFrame([(1, 2, 0, 1.0)], "player int, round int, match int, v double")
    specs = {"lag": ("v", 2)}
    _, state = incremental.advance(incremental.no_state(df, ["player"], ["round", "match"], ["v"]), df, ["player"], ["round", "match"], specs)
    with pytest.raises(Exception, match="not later"):
        incremental.advance(settled(state), df, ["player"], ["round", "match"], specs)[0].collect()


def test_form_by_round_equals_the_whole(spark):
    rng = random.Random(4)
    rows = [("s", n, t, m, rng.randrange(4), rng.choice([None, 1, 2])) for m, (n, t) in enumerate((n, t) for n in range(1, 9) for t in "abcd" for _ in range(rng.randrange(3)))]
    df = settled(spark.createDataFrame(rows, "season string, round int, team string, match_id int, points int, shots int"))
    want = {(r.round, r.team): r for r in standings.rolling_form(df, ["points", "shots"]).collect()}
    keys, order = ["season", "team"], ["round", "match_id"]
    state = incremental.no_state(df, keys, order, ["points", "shots"])
    met = 0
    for n in range(1, 9):
        for r in incremental.form(state, keys, ["points", "shots"]).collect():
            w = want[n, r.team]
            assert all(r[c] == pytest.approx(w[c]) if w[c] is not None else r[c] is None for c in r.__fields__ if c.startswith("form"))
            met += 1
        state = settled(incremental.advance_matches(state, df.filter(F.col("round") == n), keys, order, ["points", "shots"], 5))
    assert met > 20


def test_merged_sketches_equal_one_profile(spark):
    df = spark.range(20_000).select((F.col("id") % 7).alias("season"), (F.col("id") % 5000).alias("e"), F.when(F.col("id") % 3 > 0, 1).alias("c"))
    parts = settled(aggs.profile_sketches(df, ["season"], ["e"], {"low": F.col("e") < 10}, ["c"]))
    r = aggs.merged_profile(parts, [], ["e"], ["low"], ["c"]).first()
    assert (r["rows"], r["low"], r["n_c"]) == (20_000, 40, df.filter("c = 1").count()) and abs(r.distinct_e - 5000) < 3 * 1.04 / 64 * 5000
    # A season added later merges with the report of the others.
    more = aggs.profile_sketches(spark.range(5000, 6000).select(F.lit(9).cast("bigint").alias("season"), F.col("id").alias("e"), F.lit(1).alias("c")), ["season"], ["e"], {"low": F.col("e") < 10}, ["c"])
    assert abs(aggs.merged_profile(parts.unionByName(more), [], ["e"], ["low"]).first().distinct_e - 6000) < 3 * 1.04 / 64 * 6000


def test_blocks_in_one_pass(spark):
    pages = [(1, "<b k='x'>one</b> <b>two\x01</b> $1 <b k=''></b>"), (2, ""), (3, None), (4, "no block")]
    df = spark.createDataFrame(pages, "id int, html string")
    got = tb.extract_blocks(df, "html", r"<b(?: k='([^']*)')?>([^<]*)</b>", ["k", "body"], ["id"])
    assert sorted(map(tuple, got.collect())) == [(1, 0, "x", "one"), (1, 1, "", "two"), (1, 2, "", "")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1 and "regexp_extract" not in plan


def test_nearest_day_with_ties_and_days_in_the_order(spark):
    left = spark.createDataFrame([(1, "2024-01-05"), (2, "2024-01-05"), (3, "2024-01-05"), (None, "2024-01-05")], "k int, day string").withColumn("day", F.to_date("day"))
    right = spark.createDataFrame([(1, "2024-01-04", 1), (1, "2024-01-06", 2), (1, "2024-01-06", 3), (2, "2024-01-04", 4), (3, "2024-01-08", 5)], "k int, day string, v int").withColumn("day", F.to_date("day"))
    got = joins.join_within_days(left, right, ["k"], "day", ["v"], ["day", "v"])
    # One exchange for the right side, one for the left.
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2
    assert sorted(((r.k, r.day_offset, r.v) for r in got.collect()), key=str) == [(1, 1, 3), (2, -1, 4), (3, None, None), (None, None, None)]


def test_ranks_of_small_and_large_groups_agree(spark):
    df = spark.createDataFrame([("g", i, float(i % 5) if i % 4 else None, float(i % 7)) for i in range(60)] + [(None, 99, 1.0, 1.0)], "g string, id int, a double, b double")
    small = ranking.rank_divergence(df.filter("g is not null"), "g", "a", "b", ["id"])
    large = ranking.rank_divergence(df.filter("g is not null"), "g", "a", "b", ["id"], group_rows=5)
    plain = lambda x: sorted((r.id, r.rank_a, r.rank_b, r.divergence, round(r.z, 9), r.verdict) for r in x.collect())
    assert plain(small) == plain(large)
    assert ranking.rank_divergence(df.limit(0), "g", "a", "b", ["id"]).count() == 0


def test_the_chosen_length_is_the_curves_minimum(spark):
    from terrace.operators import models

    assert models.chosen_length([3.0, 2.0, 2.5, 1.0, 1.0, 4.0]) == 4 and models.chosen_length([3.0, 2.0, 2.5, 2.4, 1.0], patience=2) == 2 and models.chosen_length([1.0]) == 1
    rng = random.Random(6)
    rows = [(x := rng.random(), rng.random() + (0.2 * x if i % 2 else 0), "train" if i % 3 else "val") for i in range(400)]
    df = spark.createDataFrame(rows, "x double, y double, split string")
    long = models.train_targets(df.filter("split = 'train'"), ["y"], ["x"], max_iter=30, leaves=16)["y"].stages[-1]
    assert len(long.trees) == 30 and max(t.depth for t in long.trees) == 4
    short = models.train_targets(df, ["y"], ["x"], max_iter=30, leaves=16)["y"]
    prepared = df.filter("split = 'val'")
    for stage in short.stages[:-1]:
        prepared = stage.transform(prepared if "_n_x" in prepared.columns else prepared.withColumn("_n_x", F.lit(0.0)))
    curve = long.evaluateEachIteration(prepared, "squared")
    n = len(short.stages[-1].trees)
    assert n == models.chosen_length(curve) == curve.index(min(curve)) + 1 < 30
    assert [t.toDebugString.split("\n", 1)[1] for t in short.stages[-1].trees] == [t.toDebugString.split("\n", 1)[1] for t in long.trees[:n]]


def test_seasons_are_written_before_they_are_put_together(spark):
    from terrace.plans import registry

    registry.load()
    plan = registry.QUERIES["w5_w6_incremental"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan
