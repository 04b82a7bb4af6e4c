"""Form and lags advanced round by round: a small state per key in place of its history.

The state of a key is its last rows (as many as the longest window) and how many rows it has had. A round reads the state
and its own rows only, gives their features, and leaves the next state; both are tables, so a season is a loop over
written tables, and each round costs what the round and the keys' states cost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType


def no_state(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The state before the first round: ``keys, recent, seen``, no rows."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    each = StructType([StructField(c, kinds[c]) for c in dict.fromkeys([*order, *values])])
    schema = StructType([*[StructField(k, kinds[k]) for k in keys], StructField("recent", ArrayType(each)), StructField("seen", LongType())])
    return rows.sparkSession.createDataFrame([], schema)


def _with_state(state: DataFrame, batch: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Kept rows and new rows of each key in one table. A new row that is not later than its key's last one is an error:
    its place in the windows is gone."""
    fields = list(dict.fromkeys([*order, *values]))
    kept = state.select(*keys, "seen", F.explode("recent").alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in fields], F.lit(True).alias("_old"), "seen")
    new = batch.withColumns({"_old": F.lit(False), "seen": F.lit(0).cast("bigint")})
    both = new.unionByName(kept, allowMissingColumns=True).withColumn("_seen", F.max("seen").over(Window.partitionBy(*keys)))
    last = F.max(F.when(F.col("_old"), F.struct(*order))).over(Window.partitionBy(*keys))
    late = ~F.col("_old") & (F.struct(*order) <= last)
    return both.withColumn("_old", F.when(late, F.raise_error(F.lit("a row is not later than the state of its key")).cast("boolean")).otherwise(F.col("_old"))).drop("seen")


def advance(state: DataFrame, batch: DataFrame, keys: list[str], order: list[str], specs: dict[str, tuple[str, int]], cap: int | None = 5) -> tuple[DataFrame, DataFrame]:
    """W5, W6 for the rows of one round: their features as ``lags.player_lags`` gives them, and the next state.

    ``specs`` and ``cap`` as there. Rows of several rounds may come at once; rows without a key fall away.
    """
    values = list(dict.fromkeys(c for c, _ in specs.values()))
    keep = max([k for _, k in specs.values()])
    both = _with_state(state, batch.dropna(subset=keys), keys, order, values)
    w = Window.partitionBy(*keys).orderBy(*order)
    # Rows of the state and of the batch before this one; the state knows how many it no longer holds.
    old = F.count_if("_old").over(Window.partitionBy(*keys))
    earlier = F.col("_seen") - old + F.count("*").over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = both.withColumns({name: F.avg(c).over(w.rowsBetween(-k, -1)) for name, (c, k) in specs.items()} | {"earlier": F.least(earlier, F.lit(cap)) if cap else earlier})
    features = out.filter(~F.col("_old")).select(*batch.columns, *specs, F.col("earlier").cast("bigint").alias("earlier"))
    return features, next_state(both, keys, order, values, keep)


def next_state(both: DataFrame, keys: list[str], order: list[str], values: list[str], keep: int) -> DataFrame:
    fields = list(dict.fromkeys([*order, *values]))
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    # At most ``keep`` rows a key.
    recent = F.array_sort(F.collect_list(F.when(F.col("_back") <= keep, F.struct(*fields))))
    return both.withColumn("_back", back).groupBy(*keys).agg(recent.alias("recent"), (F.max("_seen") + F.count_if(~F.col("_old"))).alias("seen"))


def advance_matches(state: DataFrame, batch: DataFrame, keys: list[str], order: list[str], values: list[str], keep: int) -> DataFrame:
    """W4: the state after a round's matches."""
    return next_state(_with_state(state, batch.dropna(subset=keys).select(*keys, *dict.fromkeys([*order, *values])), keys, order, values), keys, order, values, keep)


def form(state: DataFrame, keys: list[str], values: list[str], windows: tuple[int, ...] = (3, 5)) -> DataFrame:
    """W4: the form before the next round, from the state alone: means of the last matches' values, nulls skipped, and how
    many matches there were."""

    def mean(v: str, w: int) -> Column:
        cells = F.filter(F.transform(F.slice("recent", -F.least(F.lit(w), F.size("recent")), w), lambda r: r[v].cast("double")), lambda x: x.isNotNull())
        total = F.aggregate(cells, F.lit(0.0), lambda acc, x: acc + x)
        return F.when(F.size(cells) > 0, total / F.size(cells)).alias(f"form{w}_{v}")

    return state.select(*keys, *[mean(v, w) for w in windows for v in values], *[F.least(F.lit(w), F.size("recent")).cast("bigint").alias(f"form{w}_n") for w in windows])
