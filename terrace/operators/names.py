"""Names: match scores inside a block, the best match by an index, and one-to-one assignment."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.operators.ranking import summed_before
from terrace.operators.rounds import settled

#: Pairs of a block that one task walks through in order.
WALK_PAIRS = 200_000


def name_score(short: Column, full: Column, contains: float = 0.0) -> Column:
    """J4. How well a short name fits a full one, both normalised; null where it does not.

    3 equal; 2 the short name is a token of the full one; 1 its first token is one and another token begins with its
    last; 1 either ends with the other; ``contains`` either is part of the other.
    """
    s, f = F.split(short, " "), F.split(full, " ")
    initial = (F.size(s) >= 2) & F.array_contains(f, s[0]) & F.exists(F.filter(f, lambda x: x != s[0]), lambda x: x.startswith(F.element_at(s, -1)))
    return (
        F.when((short == "") | (full == ""), None)
        .when(short == full, 3.0)
        .when(F.array_contains(f, short), 2.0)
        .when(initial, 1.0)
        .when(full.endswith(short) | short.endswith(full), 1.0)
        .when(full.contains(short) | short.contains(full), contains)
    )


def best_name_match(names: DataFrame, roster: DataFrame, block: list[str], key: str, short: str, candidate: str, full: str, min_score: float = 1.0, contains: float = 0.0, both_ways: bool = False) -> DataFrame:
    """J6 over J4's score, without pairs: the best candidate of each key inside its block over all its spellings.

    Every rule of the score is an equality of keys: what the rules ask of the full name (itself, its tokens, token and
    beginning of another token, its endings) is written out once, with the smallest candidate of each, and the short name
    asks for what it is. Endings go both ways. So a spelling meets a row per rule at most, whatever the block holds, and
    a token that everybody has is one row. Names that merely lie within each other go the way of ``contains_match``, only
    if ``contains`` reaches the least score. ``both_ways`` also takes the candidate as the short name. Ties go to the
    smallest candidate; null and empty names match nothing; null blocks are no block.
    """
    own = names.filter((F.col(short) != "") & F.col(key).isNotNull()).select(*block, F.col(key).alias("_k"), F.col(short).alias("_n")).distinct()
    theirs = roster.filter((F.col(full) != "") & F.col(candidate).isNotNull()).select(*block, F.col(candidate).alias("_c"), F.col(full).alias("_n"))
    hits = None
    for asks, answers in ((_short_keys, _full_keys), (_full_keys, _short_keys))[: 1 + both_ways]:
        index = theirs.select(*block, "_c", F.explode(answers(F.col("_n"), min_score)).alias("_x")).groupBy(*block, "_x").agg(F.min("_c").alias("_c"))
        met = own.select(*block, "_k", F.explode(asks(F.col("_n"), min_score)).alias("_x")).join(index, [*block, "_x"])
        found = met.select(*block, "_k", F.col("_x.s").alias("_s"), "_c")
        hits = found if hits is None else hits.unionByName(found)
    if contains >= min_score:
        from terrace.operators.joins import contains_match

        within = contains_match(own, theirs.withColumnRenamed("_n", "_full"), block, "_k", "_n", "_full", "_c", keep="_c")
        hits = hits.unionByName(within.select(*block, "_k", F.lit(contains).alias("_s"), "_c"))
    out = hits.groupBy(*block, "_k").agg(F.min(F.struct((-F.col("_s")).alias("less"), F.col("_c").alias("candidate"))).alias("best"))
    return out.select(*block, F.col("_k").alias(key), (-F.col("best.less")).alias("score"), F.col("best.candidate").alias(candidate))


def _key(rule: str, score: float, *parts: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), F.lit(score).alias("s"), F.concat_ws("\u0001", *parts).alias("v"))


def _endings(c: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(c, i, F.length(c)))


_KEYS = "array<struct<rule:string,s:double,v:string>>"


def _rules(min_score: float, *rules: tuple[float, Column]) -> Column:
    return F.array_distinct(F.concat(*[a for s, a in rules if s >= min_score], F.array().cast(_KEYS)))


def _short_keys(c: Column, min_score: float) -> Column:
    """What a short name asks for, by the rules of ``name_score``."""
    parts = F.split(c, " ")
    initial = F.when(F.size(parts) >= 2, F.array(_key("initial", 1.0, parts[0], F.element_at(parts, -1)))).otherwise(F.array().cast(_KEYS))
    ends = F.concat(F.array(_key("end", 1.0, c)), F.transform(_endings(c), lambda e: _key("ended", 1.0, e)))
    return _rules(min_score, (3.0, F.array(_key("equal", 3.0, c))), (2.0, F.array(_key("token", 2.0, c))), (1.0, initial), (1.0, ends))


def _full_keys(c: Column, min_score: float) -> Column:
    """What a full name answers to."""
    parts = F.array_distinct(F.split(c, " "))
    begun = lambda t, u: F.transform(F.sequence(F.lit(0), F.length(u)), lambda i: _key("initial", 1.0, t, F.substring(u, F.lit(1), i)))
    initial = F.flatten(F.flatten(F.transform(parts, lambda t: F.transform(F.filter(parts, lambda u: u != t), lambda u: begun(t, u)))))
    ends = F.concat(F.array(_key("ended", 1.0, c)), F.transform(_endings(c), lambda e: _key("end", 1.0, e)))
    return _rules(min_score, (3.0, F.array(_key("equal", 3.0, c))), (2.0, F.transform(parts, lambda t: _key("token", 2.0, t))), (1.0, initial), (1.0, ends))


def greedy_match(pairs: DataFrame, block: list[str], a: str, b: str, score: str, walk_pairs: int = WALK_PAIRS) -> DataFrame:
    """J5. Pairs by falling score (then a, then b); each side is used once in its block.

    A block of ``walk_pairs`` pairs or fewer is walked through in order by one task. Larger blocks go in rounds, each of
    which takes pairs that the walk would take, until what is left of them is small:

    * a pair that is the first of both its sides;
    * where some a's and some b's have each other, and nobody else, as their equally best partners, the first a gets the
      first b, the second the second and so on, however many there are;
    * if these two have left most pairs in place, the block's first ``walk_pairs`` pairs are walked through.

    So the number of rounds does not grow with the number of equal scores. Rows with a null in block, a, b or score take
    no part; of repeated pairs the best counts.
    """
    left = pairs.dropna(subset=[*block, a, b, score]).groupBy(*block, a, b).agg(F.max(score).alias(score))
    left, taken = settled(left), None
    also = lambda rows: rows if taken is None else taken.unionByName(rows)
    while True:
        sizes = left.groupBy(*block).agg(F.count("*").alias("_pairs"))
        before, largest = sizes.agg(F.sum("_pairs"), F.max("_pairs")).first()
        if (largest or 0) <= walk_pairs:
            return also(_walked(left, block, a, b, score))
        small = left.join(sizes.filter(F.col("_pairs") <= walk_pairs), [*block], "left_semi")
        taken = also(settled(_walked(small, block, a, b, score)))
        left = left.join(sizes.filter(F.col("_pairs") > walk_pairs), [*block], "left_semi")
        won = settled(_certain(left, block, a, b, score))
        taken = also(won)
        left = settled(_without(left, won, block, a, b))
        if left.count() > before / 2:
            won = settled(_walked(_first(left, block, a, b, score, walk_pairs), block, a, b, score))
            taken = also(won)
            left = settled(_without(left, won, block, a, b))


def _without(left: DataFrame, won: DataFrame, block: list[str], a: str, b: str) -> DataFrame:
    return left.join(won.select(*block, a), [*block, a], "left_anti").join(won.select(*block, b), [*block, b], "left_anti")


def _walked(pairs: DataFrame, block: list[str], a: str, b: str, score: str) -> DataFrame:
    """The walk itself: a task goes once through its blocks' pairs in order and remembers the names of one block."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, used_a, used_b = None, set(), set()
        for rows in batches:
            keep = []
            for *key, x, y in zip(*(rows[c] for c in [*block, a, b]), strict=True):
                if key != at:
                    at, used_a, used_b = key, set(), set()
                free = x not in used_a and y not in used_b
                keep.append(free)
                if free:
                    used_a.add(x)
                    used_b.add(y)
            yield rows[keep]

    dealt = pairs.select(*block, a, b, score).repartition(*block).sortWithinPartitions(*block, F.desc(score), a, b)
    return dealt.mapInPandas(walk, dealt.schema)


def _first(pairs: DataFrame, block: list[str], a: str, b: str, score: str, most: int) -> DataFrame:
    """The first pairs of each block in the order of the walk."""
    one = pairs.withColumn("_block", F.struct(*block))
    return summed_before(one, "_block", [F.desc(score), F.col(a), F.col(b)], F.lit(1), "_place").filter(F.col("_place") < most).select(*pairs.columns)


def _certain(left: DataFrame, block: list[str], a: str, b: str, score: str) -> DataFrame:
    """Pairs that the walk takes whatever else there is: firsts of both sides, and closed groups of equals in order."""

    def side(own: str, other: str, tag: str) -> DataFrame:
        # Best score of each, how many partners have it, and the first of them.
        per = left.groupBy(*block, own, score).agg(F.count("*").alias("n"), F.min(other).alias("first"))
        return per.groupBy(*block, own).agg(F.max(F.struct(F.col(score).alias("best"), "n", "first")).alias(tag))

    met = left.join(side(a, b, "_a"), [*block, a]).join(side(b, a, "_b"), [*block, b])
    mutual = settled(met.filter((F.col(score) == F.col("_a.best")) & (F.col(score) == F.col("_b.best"))))
    firsts = mutual.filter((F.col(b) == F.col("_a.first")) & (F.col(a) == F.col("_b.first"))).select(*left.columns)
    # A group goes by its a's first partner. It is closed if its b's have no other group, nobody has an equally good
    # partner outside, and everybody has everybody.
    group = F.col("_a.first")
    per_a = mutual.groupBy(*block, group.alias("_g"), a).agg((F.count("*") == F.max("_a.n")).alias("in"), F.max("_a.n").alias("n"))
    per_b = mutual.groupBy(*block, b).agg(F.min(group).alias("_g"), ((F.count("*") == F.max("_b.n")) & (F.min(group) == F.max(group))).alias("in"), F.max("_b.n").alias("n"))
    whole = lambda per, tag: per.groupBy(*block, "_g").agg(F.count("*").alias(f"_{tag}"), (F.bool_and("in") & (F.min("n") == F.max("n"))).alias(f"_{tag}_in"), F.max("n").alias(f"_{tag}_n"))
    closed = whole(per_a, "as").join(whole(per_b, "bs"), [*block, "_g"]).filter("_as_in and _bs_in and _as_n = _bs and _bs_n = _as and _as > 1 and _bs > 1").select(*block, "_g")
    closed = settled(closed)
    if closed.isEmpty():
        return firsts
    key = F.struct(*block, "_g").alias("_key")
    numbered = lambda per, own: summed_before(per.join(closed, [*block, "_g"], "left_semi").select(key, own), "_key", [F.col(own)], F.lit(1), "_i")
    equal = numbered(per_a, a).join(numbered(per_b, b), ["_key", "_i"]).select(*[F.col(f"_key.{c}").alias(c) for c in block], a, b)
    scored = equal.join(left, [*block, a, b]).select(*left.columns)
    return firsts.unionByName(scored).distinct()
