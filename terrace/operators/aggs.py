"""Aggregations and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.operators.ranking import summed_before


def player_season(df: DataFrame, keys: list[str], means: list[str], sums: list[str]) -> DataFrame:
    """A1. Mean of the ratings, sums of the counters (absent counters are 0), number of appearances."""
    return df.groupBy(*keys).agg(*[F.avg(c).alias(f"mean_{c}") for c in means], *[F.sum(F.coalesce(c, F.lit(0.0))).alias(f"sum_{c}") for c in sums], F.count("*").alias("appearances"))


def stat_season(df: DataFrame, keys: list[str], sums: list[str], position: str, sub: str) -> DataFrame:
    """A2. Sums, and the rows whose position is not the substitutes' (an unknown position counts as a start)."""
    return df.groupBy(*keys).agg(*[F.sum(c).alias(f"sum_{c}") for c in sums], F.count_if(~F.col(position).eqNullSafe(F.lit(sub))).alias("starts"))


def by_side(df: DataFrame, keys: list[str], side: str, home: str, value: str) -> DataFrame:
    """A3. One sum per side of the match, in one pass."""
    v = F.col(value)
    return df.groupBy(*keys).agg(F.sum(F.when(F.col(side) == home, v).otherwise(0.0)).alias(f"{value}_home"), F.sum(F.when(F.col(side) != home, v).otherwise(0.0)).alias(f"{value}_away"))


def final_standing(df: DataFrame, keys: list[str], round_: str) -> DataFrame:
    """A4. The row of the largest round of each key. These standings are those before that round."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), round_).alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def injury_columns(key: str, season: str, n: Column, days: Column) -> list[Column]:
    """A5. Over rows per key and season with their number of episodes and days: those of the season before, and the
    episodes of all earlier seasons; none is 0. A row whose numbers are null has none of its own."""
    w = Window.partitionBy(key).orderBy(season)
    past = w.rangeBetween(Window.unboundedPreceding, -1)
    return [
        F.coalesce(F.sum(n).over(w.rangeBetween(-1, -1)), F.lit(0)).alias("injuries_prev"),
        F.coalesce(F.sum(days).over(w.rangeBetween(-1, -1)), F.lit(0.0)).alias("days_prev"),
        F.coalesce(F.sum(n).over(past), F.lit(0)).alias("injuries_career"),
    ]


def injury_features(spine: DataFrame, episodes: DataFrame, key: str, season: str, days: str) -> DataFrame:
    """A5. Episodes and days of the season before, and episodes of all earlier seasons; none is 0.

    Episodes are counted per key and season first; spine and counts are then one ordered stream per key, so no range
    join is needed.
    """
    counts = episodes.groupBy(key, season).agg(F.count("*").alias("n"), F.sum(days).alias("d"))
    rows = spine.select(key, season).distinct().withColumns({"n": F.lit(0).cast("bigint"), "d": F.lit(0.0), "_spine": F.lit(True)})
    both = rows.unionByName(counts.withColumn("_spine", F.lit(False)))
    return both.select(key, season, "_spine", *injury_columns(key, season, F.col("n"), F.col("d"))).filter("_spine").drop("_spine")


def rosters(df: DataFrame, block: list[str], name: str) -> DataFrame:
    """A6. The distinct names of each block."""
    return df.select(*block, name).filter(F.col(name).isNotNull()).distinct()


def coverage(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """A7. Rows, filled cells and their share in percent for each column, per group."""
    return df.groupBy(*by).agg(F.count("*").alias("rows"), *[x for c in cols for x in (F.count(c).alias(f"n_{c}"), F.round(100.0 * F.count(c) / F.count("*"), 4).alias(f"pct_{c}"))])


def regression_metrics(df: DataFrame, y: str, pred: str, by: list[str]) -> DataFrame:
    """A8. MAE, RMSE, R2 and n per group, over rows that have both values. R2 is null for a constant target."""
    e = F.col(y) - F.col(pred)
    rows = df.filter(F.col(y).isNotNull() & F.col(pred).isNotNull())
    var = F.var_pop(y) * F.count("*")
    return rows.groupBy(*by).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.when(var > 0, 1 - F.sum(e * e) / var).alias("r2"), F.count("*").alias("n"))


def bias_report(df: DataFrame, group: str, y: str, pred: str, min_n: int = 30, k: int = 5) -> DataFrame:
    """A9. Groups with enough rows and the k lowest and k highest mean errors (ties by group)."""
    bias = df.groupBy(group).agg(F.round(F.avg(F.col(pred) - F.col(y)), 6).alias("bias"), F.count("*").alias("n")).filter(F.col("n") >= min_n)
    low = bias.orderBy(F.col("bias").asc(), group).limit(k).withColumn("end", F.lit("low"))
    high = bias.orderBy(F.col("bias").desc(), group).limit(k).withColumn("end", F.lit("high"))
    return low.unionByName(high)


def medians(df: DataFrame, cols: list[str], fit: Column, accuracy: int | None = None) -> DataFrame:
    """A10. One row: medians over the rows to fit on, null for a column without values.

    Equal values are counted first; the middle ones are then found by their places among the counted values, sorted in
    ranges, so no task holds a whole column. That keeps a table in the shared folder. With ``accuracy`` the medians are
    estimates instead, each within 1 / accuracy of the middle place, in one lazy pass.
    """
    rows = df.filter(fit)
    if accuracy:
        return rows.agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5, accuracy).alias(c) for c in cols])
    cells = rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols])))
    counted = cells.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("n"))
    placed = summed_before(counted, "column", [F.col("value")], F.col("n"), "before")
    # As many rows as columns.
    totals = F.broadcast(placed.groupBy("column").agg(F.sum("n").alias("total")))
    holds = lambda place: (F.col("before") <= F.floor(place)) & (F.col("before") + F.col("n") > F.floor(place))
    middle = lambda c, place: F.max(F.when((F.col("column") == c) & holds(place), F.col("value")))
    total = F.col("total")
    return placed.join(totals, "column").agg(*[((middle(c, (total - 1) / 2) + middle(c, total / 2)) / 2).alias(c) for c in cols])


def median_impute(df: DataFrame, cols: list[str], fit: Column, accuracy: int | None = None) -> DataFrame:
    """A10. Gaps filled by the median of the fit rows; a column without any value there keeps its gaps. The medians are
    one row that joins."""
    m = F.broadcast(medians(df, cols, fit, accuracy).alias("m"))
    filled = [F.coalesce(f"d.{c}", f"m.{c}").alias(c) if c in cols else F.col(f"d.{c}") for c in df.columns]
    return df.alias("d").join(m).select(*filled)


def compare_models(df: DataFrame, a: str, b: str, n: str) -> DataFrame:
    """A11. One row over per-key errors: plain means, means weighted by n, share of keys where a is lower, verdict."""
    weighted = lambda c: F.sum(F.col(c) * F.col(n)) / F.sum(n)
    out = df.agg(F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), weighted(a).alias("weighted_a"), weighted(b).alias("weighted_b"), F.avg((F.col(a) < F.col(b)).cast("int")).alias("share_a"), F.count("*").alias("keys"))
    return out.withColumn("verdict", F.when(F.col("weighted_a") < F.col("weighted_b"), "a").otherwise("b"))


def profile(df: DataFrame, entities: list[str], checks: dict[str, Column], exact: bool = True) -> DataFrame:
    """A12. One row: distinct entities and how many rows pass each check. At scale ``exact=False`` estimates."""
    count = F.count_distinct if exact else F.approx_count_distinct
    return df.agg(F.count("*").alias("rows"), *[count(c).alias(f"distinct_{c}") for c in entities], *[F.count_if(c).alias(name) for name, c in checks.items()])


def profile_sketches(df: DataFrame, by: list[str], entities: list[str], checks: dict[str, Column], cols: list[str] = [], lg_k: int = 12) -> DataFrame:  # noqa: B006
    """A7, A12. One row per group (a season, a load) that can be stored and merged: rows, rows that pass each check,
    filled cells of each column, and a sketch of the distinct values of each entity. ``lg_k``: a sketch has 2^lg_k cells,
    and its estimate a relative standard error of about 1.04 / sqrt(2^lg_k)."""
    sketches = [F.hll_sketch_agg(F.col(c).cast("string"), F.lit(lg_k)).alias(f"sketch_{c}") for c in entities]
    return df.groupBy(*by).agg(F.count("*").alias("rows"), *[F.count_if(c).alias(name) for name, c in checks.items()], *[F.count(c).alias(f"n_{c}") for c in cols], *sketches)


def merged_profile(sketches: DataFrame, by: list[str], entities: list[str], checks: list[str], cols: list[str] = []) -> DataFrame:  # noqa: B006
    """A7, A12. The report over stored rows of ``profile_sketches``: counts and shares are exact, distinct numbers are
    estimates. A new season adds its row; nothing is read again."""
    shares = [x for c in cols for x in (F.sum(f"n_{c}").alias(f"n_{c}"), F.round(100.0 * F.sum(f"n_{c}") / F.sum("rows"), 4).alias(f"pct_{c}"))]
    distinct = [F.hll_sketch_estimate(F.hll_union_agg(f"sketch_{c}")).alias(f"distinct_{c}") for c in entities]
    return sketches.groupBy(*by).agg(F.sum("rows").alias("rows"), *[F.sum(c).alias(c) for c in checks], *shares, *distinct)
