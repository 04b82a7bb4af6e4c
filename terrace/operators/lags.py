"""Windows over a player's earlier appearances and seasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def player_lags(df: DataFrame, player: str, order: list[str], specs: dict[str, tuple[str, int]], cap: int | None = 5) -> DataFrame:
    """W5, W6. Means over the last k earlier appearances across seasons, nulls skipped; and the number of earlier
    appearances, capped at 5 unless ``cap`` is None. ``specs``: name -> (column, k). Rows without a player fall away first:
    they would form one group."""
    w = Window.partitionBy(player).orderBy(*order)
    earlier = F.count("*").over(w.rowsBetween(-cap, -1) if cap else w.rowsBetween(Window.unboundedPreceding, -1))
    return df.filter(F.col(player).isNotNull()).select("*", *[F.avg(c).over(w.rowsBetween(-k, -1)).alias(name) for name, (c, k) in specs.items()], earlier.alias("earlier"))


def season_features(df: DataFrame, player: str, season: str, metrics: list[str], span: int = 3, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """W7 to W11. For each metric: last season's value (null after a gap), mean, population spread and trend over the
    seasons of the last three that have one (spread and trend need two), mean over all earlier seasons; and how many
    seasons came earlier. The trend is the least-squares slope over places 0..n-1 of the values, which for up to three
    is (last - first) / (n - 1). The columns ``keep`` stay beside them, so that no join has to bring them back."""
    if span > 3:
        raise ValueError("the closed form of the trend holds for up to three seasons")
    w = Window.partitionBy(player).orderBy(season)
    near, far = w.rangeBetween(-span, -1), w.rangeBetween(Window.unboundedPreceding, -1)

    def of(m: str) -> list[Column]:
        n, first, last = F.count(m).over(near), F.first(m, ignorenulls=True).over(near), F.last(m, ignorenulls=True).over(near)
        return [
            F.avg(m).over(w.rangeBetween(-1, -1)).alias(f"{m}_lag1"),
            F.avg(m).over(near).alias(f"{m}_mean"),
            F.when(n >= 2, F.stddev_pop(m).over(near)).alias(f"{m}_std"),
            F.when(n >= 2, (last - first) / (n - 1)).alias(f"{m}_trend"),
            F.avg(m).over(far).alias(f"{m}_career"),
        ]

    return df.select(player, season, *keep, *[c for m in metrics for c in of(m)], F.count("*").over(far).alias("earlier_seasons"))
