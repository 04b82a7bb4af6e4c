"""Matching inside blocks: one-to-one, best and contained names, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from terrace.operators import joins, names
from terrace.operators.names import best_name_match, greedy_match, name_score


def walk(rows):
    """The pairs one by one: by falling score, then a, then b."""
    used, out = set(), []
    for block, a, b, s in sorted(rows, key=lambda r: (r[0], -r[3], r[1].encode(), r[2].encode())):
        if (block, 0, a) not in used and (block, 1, b) not in used:
            used |= {(block, 0, a), (block, 1, b)}
            out.append((block, a, b, s))
    return sorted(out)


def greedy(spark, rows, walk_pairs):
    df = spark.createDataFrame(rows, "block string, a string, b string, score double").repartition(3)
    return sorted(map(tuple, greedy_match(df, ["block"], "a", "b", "score", walk_pairs).collect()))


@pytest.mark.parametrize("walk_pairs", [20, 10**6])
def test_greedy_equals_the_walk(spark, walk_pairs):
    rng = random.Random(walk_pairs)
    rows = [(rng.choice("xy"), rng.choice(["ä", "z", "Z", *"abcdefghij"]), str(rng.randrange(14)), float(rng.randrange(3))) for _ in range(260)]
    rows += [("z", "one", "1", 1.0), ("z", "one", "1", 2.0)]
    best = {}
    for block, a, b, s in rows:
        best[block, a, b] = max(s, best.get((block, a, b), s))
    nulls = [(None, "a", "1", 9.0), ("x", None, "1", 9.0), ("x", "a", None, 9.0), ("x", "a", "1", None)]
    assert greedy(spark, rows + nulls, walk_pairs) == walk([(*k, s) for k, s in best.items()])


def test_tied_blocks_do_not_take_a_round_a_pair(spark, monkeypatch):
    """200 names on either side, all equally good; beside them a group of ties that a better pair opens."""
    rounds = []
    certain = names._certain
    monkeypatch.setattr(names, "_certain", lambda *x: rounds.append(1) or certain(*x))
    rows = [("tied", f"a{i:03}", f"b{j:03}", 1.0) for i in range(200) for j in range(200)]
    rows += [("open", f"a{i:02}", f"b{j:02}", 1.0) for i in range(30) for j in range(40)] + [("open", "a07", "x", 2.0), ("open", "y", "b00", 1.5)]
    assert greedy(spark, rows, 100) == walk(rows)
    assert len(rounds) <= 20


def test_a_chain_of_ties_advances_by_walks(spark, monkeypatch):
    """Every name waits for the one before it: rounds follow the number of pairs by ``walk_pairs``."""
    rounds = []
    certain = names._certain
    monkeypatch.setattr(names, "_certain", lambda *x: rounds.append(1) or certain(*x))
    rows = [("chain", f"a{i:04}", f"b{i + k:04}", 1.0) for i in range(300) for k in (0, 1)]
    assert greedy(spark, rows, 150) == walk(rows)
    assert len(rounds) <= 6


WORDS = ["rossi", "ssi", "mario", "m", "ma", "de", "luca", "bianchi", "si", "ro", ""]


def some_names(rng, n):
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 4))) for _ in range(n)]


@pytest.mark.parametrize(("least", "contains", "both"), [(1.0, 0.0, True), (1.0, 0.0, False), (2.0, 0.0, True), (3.0, 0.0, False), (0.5, 0.5, False)])
def test_best_name_by_index_equals_all_pairs(spark, least, contains, both):
    rng = random.Random(5)
    left = [(rng.choice("xy"), k // 2, s) for k, s in enumerate(some_names(rng, 120))] + [("x", 900, None), ("x", None, "rossi"), (None, 901, "rossi")]
    right = [(rng.choice("xy"), f"c{k}", s) for k, s in enumerate(some_names(rng, 60))] + [("x", "null", None), (None, "none", "rossi")]
    a = spark.createDataFrame(left, "block string, key long, spelling string")
    b = spark.createDataFrame(right, "block string, candidate string, full string")
    score = name_score(F.col("spelling"), F.col("full"), contains)
    if both:
        score = F.greatest(score, name_score(F.col("full"), F.col("spelling"), contains))
    want = joins.best_match(a.filter("key is not null"), b, ["block"], "key", "candidate", score, least)
    got = best_name_match(a, b, ["block"], "key", "spelling", "candidate", "full", least, contains, both)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert want.count() > 10


def test_a_block_of_many_names_makes_no_pairs(spark):
    """One block of 20,000 names that share a token: all pairs would be 400 million."""
    n = 20_000
    base = spark.range(n).select(F.lit("hot").alias("block"), "id", F.concat(F.lit("de "), F.conv(F.col("id").cast("string"), 10, 36)).alias("name"))
    left = base.withColumn("key", F.col("id"))
    got = best_name_match(left, base.select("block", "name", F.col("name").alias("candidate")), ["block"], "key", "name", "candidate", "name", 2.0)
    assert got.filter("score = 3").count() == n
    short = spark.createDataFrame([("hot", 1, "de")], "block string, key long, name string")
    assert best_name_match(short, base.select("block", "name", F.col("name").alias("candidate")), ["block"], "key", "name", "candidate", "name").first().candidate == "de 0"


def test_contained_names_equal_all_pairs(spark):
    rng = random.Random(8)
    text = lambda: "".join(rng.choice("abé ") for _ in range(rng.randrange(0, 9)))
    left = [(rng.choice("xyz"), k // 2, text()) for k in range(200)] + [("x", 900, None), (None, 901, "ab"), ("w", 902, "ab")]
    right = [(rng.choice("xy"), text(), rng.randrange(50)) for _ in range(70)] + [("x", None, 0), (None, "ab", 0)]
    a, b = spark.createDataFrame(left, "block string, key long, a string"), spark.createDataFrame(right, "block string, b string, place long")
    for blank in (True, False):
        rights = b if blank else b.filter("b <> '' or b is null")
        got = joins.contains_match(a, rights, ["block"], "key", "a", "b", "place")
        hit = F.col("a").contains(F.col("b")) | F.col("b").contains(F.col("a"))
        pairs = a.join(rights, "block").filter(hit).groupBy("block", "key").agg(F.min(F.struct("place", "b")).alias("m"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pairs.select("block", "key", "m.b").collect()))
        assert got.count() > 50


def test_contained_names_of_a_hot_block(spark):
    """30,000 texts with the same beginning, and as many that lie within one each."""
    n = 30_000
    texts = spark.range(n).select(F.lit("hot").alias("block"), "id", F.concat(F.lit("the same start "), F.sha2(F.col("id").cast("string"), 256)).alias("long"))
    left = texts.select("block", "id", F.substring("long", 30, 30).alias("a"))
    got = joins.contains_match(left, texts.select("block", "long", F.col("id").alias("place")), ["block"], "id", "a", "long", "place")
    assert got.join(texts, ["block", "id", "long"]).count() == n
    # Only texts that hold the rarest string of three meet: far fewer than the 900 million pairs of the block.
    met = joins._within(texts.select("block", "long"), "long", left.select("block", "a").distinct(), "a", ["block"])
    assert met.count() == n
