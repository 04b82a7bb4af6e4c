"""Tolerant typing and small column functions. Null is never turned into zero unless a function says so."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?(nan|NaN|inf|Infinity)\s*$"


def to_float(c: Column) -> Column:
    """P1. A number, or null for null, blank or unreadable text (also for ``1d``, which a cast would take)."""
    t = c.cast("string")
    return F.when(t.rlike(_NUMBER), t.try_cast("double"))


def to_bool3(c: Column) -> Column:
    """P2. Three-valued: null or blank is null, else whether the text is ``True``."""
    return F.when(c.isNull() | (c == ""), None).otherwise(c == "True")


def flag01(c: Column) -> Column:
    """P2. Two-valued: 1.0 for ``True``, 0.0 for all else and null."""
    return F.when(c == "True", 1.0).otherwise(0.0)


def parse_number_it(c: Column) -> Column:
    """P3. The first number inside a text, with a comma or a point before the decimals."""
    return F.replace(F.nullif(F.regexp_extract(c, r"-?\d+(?:[,.]\d+)?", 0), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def sentinel_null(c: Column, sentinel: str = "55") -> Column:
    """P4. The text, or null where it is the sign for "no rating"."""
    return F.when(F.trim(c) != sentinel, c)


def is_sentinel(*cols: Column, sentinel: str = "55") -> Column:
    """P4. Whether any of the columns is the sign for "no rating"; nulls are not."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.trim(c) == sentinel, F.lit(False)) for c in cols])


def parse_price(c: Column) -> Column:
    """P5. A price with a decimal comma; dashes, blanks and N.D. are null."""
    t = F.trim(c)
    return F.when(t.isin("-", "", "N.D."), None).otherwise(to_float(F.replace(t, F.lit(","), F.lit("."))))


def map_values(c: Column, values: Mapping[str, str]) -> Column:
    """P6. Replace known codes by their labels; unknown values and null pass through."""
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(table, c), c)


def season_start_year(c: Column) -> Column:
    """P7. 2023 of ``2023-24``; null for another form."""
    return F.when(c.rlike(r"^\d{4}-\d{2}$"), F.substring(c, 1, 4).try_cast("int"))


def season_label(year: Column) -> Column:
    """P7. ``2023-24`` of 2023."""
    return F.format_string("%d-%02d", year.cast("int"), F.pmod(year.cast("int") + 1, F.lit(100)))


def season_from_short(c: Column) -> Column:
    """P7. ``2023-24`` of ``23/24``; null for another form."""
    return F.when(c.rlike(r"^\d{2}/\d{2}$"), F.concat(F.lit("20"), F.substring(c, 1, 2), F.lit("-"), F.substring(c, 4, 2)))


def season_index(c: Column, seasons: list[str]) -> Column:
    """P7. Place of a season label in the ordered list; null outside it. Season order is this index, not a date."""
    return F.try_element_at(F.create_map(*[x for i, s in enumerate(seasons) for x in (F.lit(s), F.lit(i))]), c)


def extract_id(c: Column, *patterns: str) -> Column:
    """P8. The first group of the first pattern that matches; null without one."""
    return F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in patterns])


def age_on(born: Column, year: Column, month: int = 8, day: int = 1) -> Column:
    """P9. Full years on a day of a year."""
    early = (F.month(born) > month) | ((F.month(born) == month) & (F.dayofmonth(born) > day))
    return (year - F.year(born) - early.cast("int")).cast("int")


def day_it(c: Column) -> Column:
    """P9. A dd/MM/yyyy date; null where it does not exist."""
    return F.try_to_date(c, "dd/MM/yyyy")


def parse_height(c: Column) -> Column:
    """P10. 1.89 of ``1,89 m``."""
    return F.replace(F.nullif(F.regexp_extract(c, r"(\d+[,.]\d+)", 1), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def first_int(c: Column) -> Column:
    """P10. 93 of ``93 giorni``; null without digits."""
    return F.nullif(F.regexp_extract(c, r"(\d+)", 1), F.lit("")).try_cast("int")


def day_of(c: Column) -> Column:
    """P11. The calendar day of a datetime text: its first ten characters."""
    return F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")


def _accents() -> tuple[str, str]:
    """Every letter below U+2000 with a decomposition, and its base letter: made once from the Unicode data."""
    at, to = [], []
    for n in range(0xC0, 0x2000):
        base = "".join(x for x in unicodedata.normalize("NFD", chr(n)) if not unicodedata.combining(x))
        if len(base) == 1 and base != chr(n):
            at.append(chr(n))
            to.append(base)
    return "".join(at), "".join(to)


_FROM, _TO = _accents()


def strip_accents(c: Column) -> Column:
    """P12. Letters without their marks; combining marks go. Letters with a stroke have no mark and stay."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(c, _FROM, _TO), r"\p{Mn}", "")).otherwise(c)


def norm_name(c: Column, stroke: bool = False) -> Column:
    """P12. Lower case without accents; all but letters, digits and blanks becomes one blank; null becomes ''.
    ``stroke`` first turns a stroked O into a plain one."""
    c = F.translate(c, "Øø", "Oo") if stroke else c
    return F.trim(F.regexp_replace(F.lower(strip_accents(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", " "))


def title_name(c: Column) -> Column:
    """P13. Capitals at the start of every word, also after an apostrophe."""
    return F.array_join(F.transform(F.split(F.lower(c), "'"), F.initcap), "'")


def canonical_person(first: Column, last: Column, short: Column, display: Column) -> Column:
    """P13. ``First Last`` where either is given, else the short, else the display name, in title case."""
    blank = lambda x: F.nullif(F.trim(x), F.lit(""))
    return title_name(F.coalesce(blank(F.concat_ws(" ", blank(first), blank(last))), blank(short), blank(display)))


def score_or_null(c: Column) -> Column:
    """P14. A whole-number score; ``x`` is null."""
    return F.when(F.lower(F.trim(c)) == "x", None).otherwise(F.trim(c).try_cast("int"))


def opponent(team: Column, home: Column, away: Column) -> Column:
    """P15. The other side of the team's match."""
    return F.when(team == home, away).otherwise(home)


def match_points(scored: Column, conceded: Column) -> Column:
    """P16. 3, 1 or 0 points."""
    return F.when(scored > conceded, 3).when(scored == conceded, 1).when(scored < conceded, 0)


def two_sided(matches: DataFrame, keep: list[str], home: str, away: str, home_goals: str, away_goals: str) -> DataFrame:
    """P16. Each match as two rows (team, opponent, is_home, scored, conceded, points), in one pass over it."""
    side = lambda t, o, h, s, c: F.struct(F.col(t).alias("team"), F.col(o).alias("opponent"), F.lit(h).alias("is_home"), F.col(s).alias("scored"), F.col(c).alias("conceded"))
    both = F.array(side(home, away, True, home_goals, away_goals), side(away, home, False, away_goals, home_goals))
    rows = matches.select(*keep, F.explode(both).alias("s")).select(*keep, "s.*")
    return rows.withColumn("points", match_points(F.col("scored"), F.col("conceded")))


def clamp(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """P17. Keep within bounds; null stays null."""
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def band(c: Column, high: float, low: float, labels: tuple[str, str, str]) -> Column:
    """P18. Label by threshold: at or above high, at or below low, else between; null stays null."""
    return F.when(c >= high, labels[0]).when(c <= low, labels[1]).when(c.isNotNull(), labels[2])


def in_set_flag(df: DataFrame, ref: DataFrame, keys: list[str], name: str) -> DataFrame:
    """P19. 1.0 where the keys are in the reference set, else 0.0. Spark picks the join by the set's size."""
    known = ref.select(*keys).distinct().withColumn("_in", F.lit(1.0))
    return df.join(known, keys, "left").withColumn(name, F.coalesce("_in", F.lit(0.0))).drop("_in")


def select_base(df: DataFrame, base: list[str], added: Mapping[str, list[str]]) -> DataFrame:
    """P20. Only the declared base columns, and joined ones under their prefix: whatever else was known about the
    outcome falls away."""
    return df.select(*base, *[F.col(c).alias(f"{prefix}{c}") for prefix, cols in added.items() for c in cols])
