"""Stored pages and nested JSON into rows."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def explode_match_json(df: DataFrame, json_col: str, schema: str, players: str, shots: str, meta: list[str]) -> tuple[DataFrame, DataFrame]:
    """T1. Player rows (a map of players per side) and shot rows (an array per side) of a nested match text, with the
    match's own columns."""
    parsed = df.select(*meta, F.from_json(json_col, schema).alias("_match"))
    sides = parsed.select(*meta, F.explode(f"_match.{players}").alias("side", "map"))
    rows = sides.select(*meta, "side", F.explode(F.map_values("map")).alias("r")).select(*meta, "side", "r.*")
    taken = parsed.select(*meta, F.explode(f"_match.{shots}").alias("side", "list")).select(*meta, "side", F.explode("list").alias("r")).select(*meta, "side", "r.*")
    return rows, taken


def last_entries(arr: Column, key: str, value: str) -> Column:
    """T2. Map of an array of {key, value}; of repeated keys the last counts."""
    keys = F.array_distinct(F.transform(arr, lambda e: e[key]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(arr, lambda e: e[key] == k), -1)[value].alias("value"))))


def stats_to_columns(df: DataFrame, arr: str, key: str, value: str, ids: list[str]) -> DataFrame:
    """T2. One column per wanted id; null where the row lacks it."""
    m = df.withColumn("_m", last_entries(F.col(arr), key, value))
    return m.select(*df.columns, *[F.try_element_at("_m", F.lit(i)).alias(f"stat__{i}") for i in ids])


def first_by_label(arr: Column, field: str, label: str) -> Column:
    """T3. The first element whose label matches, blanks and case aside."""
    return F.get(F.filter(arr, lambda e: F.lower(F.trim(e[field])) == label.lower()), F.lit(0))


@F.pandas_udf(StringType())
def unescape(texts: pd.Series) -> pd.Series:
    """Entities decoded; Spark has no built-in for this."""
    return texts.map(lambda t: None if t is None else html.unescape(t))


def html_to_text(c: Column, entities: bool = True) -> Column:
    """T4. Tags become blanks, entities are decoded, runs of blanks become one."""
    t = F.regexp_replace(c, "<[^>]*>", " ")
    t = F.when(t.contains("&"), unescape(t)).otherwise(t) if entities else t
    return F.trim(F.regexp_replace(t, r"[\s ]+", " "))


#: Stand around and between the groups of a match; removed from the text before.
_OPEN, _NEXT, _CLOSE = "\u0001", "\u0002", "\u0003"


def matched_groups(text: Column, pattern: str, groups: int) -> Column:
    """Every match of a pattern as an array of its groups, in one pass over the text: each match is replaced by its groups
    between marks, and the rest is cutting at marks. A group that took no part is empty; so is the array of a null text
    null."""
    marked = F.regexp_replace(F.translate(text, _OPEN + _NEXT + _CLOSE, ""), F.lit(pattern), F.lit(_OPEN + _NEXT.join(f"${i + 1}" for i in range(groups)) + _CLOSE))
    cuts = F.split(marked, _OPEN)
    return F.transform(F.slice(cuts, 2, 1 << 30), lambda c: F.split(F.substring_index(c, _CLOSE, 1), _NEXT))


def extract_blocks(df: DataFrame, col: str, pattern: str, names: list[str], keep: list[str]) -> DataFrame:
    """T5. One row per match of the pattern, a column per group, with its place; one pass over the text."""
    rows = df.select(*keep, F.posexplode(matched_groups(F.col(col), pattern, len(names))).alias("place", "b"))
    return rows.select(*keep, "place", *[F.get("b", F.lit(i)).alias(n) for i, n in enumerate(names)])


def sections(df: DataFrame, col: str, marker: str, keep: list[str]) -> DataFrame:
    """T6. ``name, body``: the text between each named marker (group 1 of the pattern) and the next marker of any name."""
    names = F.regexp_extract_all(col, F.lit(marker), F.lit(1)).alias("name")
    parts = F.split(col, marker, -1)
    bodies = F.slice(parts, F.lit(2), F.size(parts)).alias("body")
    return df.select(*keep, F.posexplode(F.arrays_zip(names, bodies)).alias("place", "s")).select(*keep, "place", "s.name", F.trim(F.col("s.body")).alias("body"))


def pct_pairs(df: DataFrame, col: str, keep: list[str]) -> DataFrame:
    """T7. ``Name [80%] - Other [20%]`` as rows of (name, pct)."""
    rows = df.select(*keep, F.explode(matched_groups(F.col(col), r"([^\[\]]+?)\s*\[(\d+)%\]", 2)).alias("x"))
    return rows.select(*keep, F.trim(F.regexp_replace(F.get("x", F.lit(0)), r"^[\s\-–]+", "")).alias("name"), F.get("x", F.lit(1)).cast("int").alias("pct"))


def split_names(df: DataFrame, col: str, keep: list[str], label: str | None = None) -> DataFrame:
    """T8. A comma list after an optional label as rows; "nessuno" and "-" are none."""
    body = F.regexp_replace(F.col(col), rf"(?i)^\s*{label}\s*:?\s*", "") if label else F.col(col)
    rows = df.select(*keep, F.explode(F.split(body, ",")).alias("name")).withColumn("name", F.trim("name"))
    return rows.filter(~F.lower("name").isin("", "-", "nessuno"))


def pairs_to_map(c: Column, sep: str) -> Column:
    """T9. Label, value, label, value ... as a map; a label without a value is dropped, of equal labels the first counts."""
    parts = F.transform(F.split(c, sep), lambda x: F.trim(x))
    n = F.floor(F.size(parts) / 2).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    entries = F.transform(at, lambda i: F.struct(F.get(parts, i * 2).alias("key"), F.get(parts, i * 2 + 1).alias("value")))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.filter(entries, lambda e: e["key"] == k)[0]))


def table_rows(df: DataFrame, col: str, keep: list[str], min_cells: int = 6) -> DataFrame:
    """T10. The cells of each table row with enough of them."""
    rows = df.select(*keep, F.posexplode(F.regexp_extract_all(col, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("place", "row"))
    cells = F.transform(F.regexp_extract_all("row", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, "<[^>]*>", "")))
    return rows.select(*keep, "place", cells.alias("cells")).filter(F.size("cells") >= min_cells)


def zip_sources(df: DataFrame, arrays: list[str], names: str, keep: list[str]) -> DataFrame:
    """T11. Arrays per rating source, zipped by position: a row per source that has any value; an unnamed source is
    ``fonte_<place>``."""
    rows = df.select(*keep, F.posexplode(F.arrays_zip(*[F.col(a) for a in [*arrays, names]])).alias("i", "z"))
    some = None
    for a in arrays:
        some = F.col(f"z.{a}").isNotNull() if some is None else some | F.col(f"z.{a}").isNotNull()
    source = F.coalesce(F.col(f"z.{names}"), F.concat(F.lit("fonte_"), F.col("i").cast("string")))
    return rows.filter(some).select(*keep, source.alias("source"), *[F.col(f"z.{a}").alias(a) for a in arrays])


def bonus_columns(df: DataFrame, arr: str, titles: dict[str, str], cards: str, card_classes: dict[str, str]) -> DataFrame:
    """T13. Bonus values by title (``titles``: column -> title; absent is 0.0), and flags for classes that any source's list holds."""
    m = last_entries(F.col(arr), "title", "value")
    values = [F.coalesce(F.try_element_at(F.col("_m"), F.lit(title)).try_cast("double"), F.lit(0.0)).alias(name) for name, title in titles.items()]
    flags = [F.coalesce(F.exists(F.col(cards), lambda c: F.array_contains(c, cls)), F.lit(False)).alias(name) for name, cls in card_classes.items()]
    return df.withColumn("_m", m).select(*df.columns, *values, *flags)
