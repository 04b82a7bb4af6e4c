"""Joins. Dimension sides are left to Spark's size-based choice unless their size is bounded by their meaning."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def lookup(df: DataFrame, dim: DataFrame, on: Mapping[str, str], prefix: str, cols: list[str]) -> DataFrame:
    """J1. Left lookup of the columns under a prefix; ``on`` maps the row's columns to the dimension's. The dimension
    must have one row per key."""
    side = dim.select(*[F.col(d).alias(f"_{d}") for d in on.values()], *[F.col(c).alias(f"{prefix}{c}") for c in cols])
    cond = [F.col(a) == F.col(f"_{d}") for a, d in on.items()]
    return df.join(side, cond, "left").drop(*[f"_{d}" for d in on.values()])


def bridge_join(df: DataFrame, bridge: DataFrame, facts: DataFrame, bridge_on: Mapping[str, str], foreign: str, fact_on: Mapping[str, str], cols: list[str], prefix: str = "") -> DataFrame:
    """J2. Names to a foreign id through the bridge, and the foreign facts by that id."""
    return lookup(lookup(df, bridge, bridge_on, "", [foreign]), facts, fact_on, prefix, cols)


def join_within_days(left: DataFrame, right: DataFrame, keys: list[str], date: str, cols: list[str], order: list[str], offsets: tuple[int, ...] = (0, 1, -1)) -> DataFrame:
    """J3. Left join on the keys and the day, else a day of the next offset; the first offset that hits wins.

    Right rows are written under every day that sees them, with the offset's place; one grouping keeps, per key and day,
    the least place and in it the last by ``order``. It combines before its exchange, and the left side, dealt by the same
    key and day, meets one row at most.
    """
    rest = [c for c in dict.fromkeys([*cols, *order]) if c not in {*keys, date}]
    shifts = F.array(*[F.struct(F.lit(-i).alias("place"), F.lit(o).alias("by")) for i, o in enumerate(offsets)])
    seen = right.select(*keys, F.explode(shifts).alias("_s"), F.col(date).alias("_day"), *rest)
    # Columns by which rows are ordered may be the key or the day themselves.
    at = [F.col("_day") if c == date else F.col(c) for c in order]
    hit = F.max_by(F.struct(F.col("_s.by").alias("day_offset"), *[F.col("_day").alias(c) if c == date else F.col(c) for c in cols]), F.struct("_s.place", *at))
    best = seen.groupBy(*keys, F.date_sub("_day", F.col("_s.by")).alias(date)).agg(hit.alias("_hit"))
    return left.join(best, [*keys, date], "left").select(*left.columns, *[F.col("_hit")[c].alias(c) for c in ["day_offset", *cols]])


def best_match(names: DataFrame, roster: DataFrame, block: list[str], key: str, candidate: str, score: Column, min_score: float) -> DataFrame:
    """J6. The best candidate of each key inside its block over all its spellings, if its score reaches the least; many
    keys may get the same. ``score`` is any expression over both sides, so all pairs of a block are scored; for name
    scores ``names.best_name_match`` needs none. Ties go to the smallest candidate."""
    pairs = names.join(roster, block).withColumn("score", score).filter(F.col("score") >= min_score)
    best = pairs.groupBy(*block, key).agg(F.min(F.struct((-F.col("score")).alias("less"), F.col(candidate).alias("candidate"))).alias("best"))
    return best.select(*block, key, (-F.col("best.less")).alias("score"), F.col("best.candidate").alias(candidate))


def contains_match(left: DataFrame, right: DataFrame, block: list[str], key: str, a: str, b: str, order: str, keep: str | None = None) -> DataFrame:
    """J7. Inside the block, the first right row (by order, then text) whose text equals, contains or lies within the
    left's; ``keep`` is the right column that is returned, its text by default.

    No pair of a block is made unless it can match: a text that lies within another brings its three-letter strings
    along, so each text is looked up under the rarest of its own among the other side's, and what meets is compared.
    Texts of one or two letters are looked up as they are. Equal texts are one. An empty text lies within every other; a
    null text or block matches nothing.
    """
    keep = keep or b
    lefts = left.select(*block, F.col(a).alias("_a")).dropna().distinct()
    first = F.min(F.struct(F.col(order).alias("o"), F.col(b).alias("b"), F.col(keep).alias("k"))).alias("_hit")
    rights = right.filter(F.col(b).isNotNull()).dropna(subset=block).groupBy(*block, F.col(b).alias("_b")).agg(first)
    hits = _within(lefts, "_a", rights, "_b", block).unionByName(_within(rights, "_b", lefts, "_a", block).select(*block, "_a", "_b", "_hit"))
    # An empty text meets the first row of its block; a block's empty row meets everybody.
    every = rights.groupBy(*block).agg(F.min("_hit").alias("_hit"))
    none = lefts.filter("_a = ''").join(every, block).select(*block, "_a", F.lit("").alias("_b"), "_hit")
    blank = lefts.join(rights.filter("_b = ''"), block).select(*block, "_a", "_b", "_hit")
    best = hits.unionByName(none).unionByName(blank).groupBy(*block, "_a").agg(F.min("_hit").alias("_hit"))
    return left.select(*block, F.col(a).alias("_a"), key).join(best, [*block, "_a"]).groupBy(*block, key).agg(F.min("_hit").alias("_hit")).select(*block, key, F.col(f"_hit.{'b' if keep == b else 'k'}").alias(keep))


#: Letters of the strings under which texts are looked up.
GRAM = 3


def _grams(c: Column, size: int) -> Column:
    places = F.when(F.length(c) >= size, F.sequence(F.lit(1), F.length(c) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(c, i, F.lit(size))))


def _within(outer: DataFrame, o: str, inner: DataFrame, i: str, block: list[str]) -> DataFrame:
    """Pairs of an outer text and a not empty inner one that lies within it, over distinct texts."""
    held = outer.select("*", F.explode(F.concat(*[_grams(F.col(o), n) for n in range(1, GRAM + 1)])).alias("_gram"))
    asked = inner.filter(F.length(i) > 0).select("*", F.explode(_grams(F.col(i), GRAM)).alias("_gram"))
    # How often the outer texts hold what inner texts ask for; a string that none holds rules the text out.
    often = held.groupBy(*block, "_gram").agg(F.count("*").alias("_n"))
    rare = asked.select(*block, i, "_gram").join(often, [*block, "_gram"], "left").groupBy(*block, i).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_gram")).alias("_r"))
    by_rare = inner.join(rare.filter("_r.n > 0").select(*block, i, F.col("_r._gram").alias("_gram")), [*block, i])
    short = inner.filter(F.length(i).between(1, GRAM - 1)).withColumn("_gram", F.col(i))
    met = held.join(by_rare.unionByName(short), [*block, "_gram"]).filter(F.col(o).contains(F.col(i)))
    return met.drop("_gram")


def apply_corrections(df: DataFrame, fixes: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """J8. The table with the trusted values in the named columns only, where there are any."""
    side = fixes.select(*keys, *[F.col(c).alias(f"_fix_{c}") for c in cols])
    joined = df.join(side, keys, "left")
    return joined.select(*[F.coalesce(f"_fix_{c}", c).alias(c) if c in cols else F.col(c) for c in df.columns])


def corrections(df: DataFrame, fixes: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """J8. The change list: keys, old and new values of the rows that the fixes alter."""
    side = fixes.select(*keys, *[F.col(c).alias(f"new_{c}") for c in cols])
    changed = None
    for c in cols:
        one = F.col(f"new_{c}").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"new_{c}"))
        changed = one if changed is None else changed | one
    return df.join(side, keys).filter(changed).select(*keys, *[x for c in cols for x in (F.col(c).alias(f"old_{c}"), F.col(f"new_{c}"))])


def correct_partitions(spark: SparkSession, path: str, fixes: DataFrame, keys: list[str], cols: list[str], by: str) -> list:
    """J8. Corrections of a stored table with a folder per value of ``by``: only folders in which a row changes are
    written anew, the files of all others stay as they are. Returns the values of those folders.

    Fixes have a row per key and don't move rows to other folders. Folders change place at the end of the job, so a job
    that fails before leaves the table as it was.
    """
    if by in cols:
        raise ValueError(f"{by} is the column that folders go by")
    table = spark.read.parquet(path)
    changed = corrections(table, fixes, keys, cols).select(*keys)
    # A value per folder.
    touched = [r[0] for r in table.join(changed, keys, "left_semi").select(by).distinct().collect()]
    if touched:
        known = F.col(by).isin([v for v in touched if v is not None])
        rows = table.filter(known | F.col(by).isNull() if None in touched else known)
        apply_corrections(rows, fixes, keys, cols).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    return touched


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """J9. Left rows without a partner."""
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def with_previous_season(df: DataFrame, key: str, season: str, cols: list[str]) -> DataFrame:
    """J10. Rows whose key also has the season before, with that season's values as ``prev_*``."""
    w = Window.partitionBy(key).orderBy(season)
    lagged = df.withColumns({f"prev_{c}": F.lag(c).over(w) for c in cols} | {"_gap": F.col(season) - F.lag(season).over(w)})
    return lagged.filter(F.col("_gap") == 1).drop("_gap")


def lookup_if(df: DataFrame, dim: DataFrame, on: Mapping[str, str], cond: Column, prefix: str, cols: list[str]) -> DataFrame:
    """J11. Lookup whose values count only where the condition holds."""
    out = lookup(df, dim, on, prefix, cols)
    return out.select(*df.columns, *[F.when(cond, F.col(f"{prefix}{c}")).alias(f"{prefix}{c}") for c in cols])


def first_resolved(spellings: DataFrame, bridge: DataFrame, on: list[str], keys: list[str], order: list[str], target: str) -> DataFrame:
    """J12. The target of the first spelling (by order) of each key that the bridge knows."""
    return spellings.join(bridge.select(*on, target), on).groupBy(*keys).agg(F.min_by(target, F.struct(*order)).alias(target))


def merge_sheet(report: DataFrame, names: DataFrame, sheet: DataFrame, name_on: list[str], key: str, cols: list[str]) -> DataFrame:
    """J13. Report rows -> id by name -> sheet columns, filled only where both are found."""
    out = report.join(names.select(*name_on, key), name_on, "left")
    return out.join(sheet.select(key, *cols), key, "left").select(*report.columns, key, *cols)
