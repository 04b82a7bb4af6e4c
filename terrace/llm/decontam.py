"""Benchmark decontamination by template canonicalisation.

Words lose their outer punctuation and case; numbers, units after numbers and names (in a second view the capitalised
words inside sentences, in a third all capitalised words) become typed placeholders, which gives a template that survives new parameters. Windows of five template words are
hashed on both sides. Documents are read once: a bounded bitmap of the benchmark's hashes drops almost every window at
once, the rest is hash-joined with the benchmark by Spark. A matched run counts only if its slots are consistent: one
value of the item must stand for one value of the document throughout. An item is found in a document when at least
0.8 of its windows are. An item without a window that says enough (almost all of it is numbers) is sought
as a whole, word by word with its values and free-standing signs.
"""

from __future__ import annotations

import re
import zlib
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import by_row, fresh_name, row_hash, settle

WINDOW, CONTAINED, MIN_WORDS = 5, 0.8, 3
#: Bits of the prefilter; its size does not depend on the benchmark. What it lets through wrongly the join removes.
FILTER_BITS = 1 << 25
_NUMBER = re.compile(r"[+\-−]?[$€£]?\d+(?:[.,:/]\d+)*(?:%|st|nd|rd|th)?$")
_MEASURE = re.compile(r"([+\-−]?\d+(?:[.,]\d+)*)([^\W\d_]{1,4}|°[CF]?)$")
#: Units of measure that become a placeholder after a number.
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years mph km/h percent dollar dollars euro euros cent cents degree degrees".split()
)
_NUM, _UNIT, _NAME = 0x1D8E4E27C47D124F, 0x3F6A2B1C5D4E7081, 0x27D4EB2F165667C5
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: The number of the view in which an item is one window of its own length.
WHOLE = 3
#: What a worker keeps of the words it has met; emptied when full.
CACHE_WORDS = 500_000


def _hash(word: str) -> int:
    b = word.encode("utf-8", "surrogatepass")
    h = zlib.crc32(b) | zlib.crc32(b"\x01" + b[::-1]) << 32
    h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 & (2**64 - 1)
    return h ^ h >> 32


class Words:
    """Numbers for raw words, with their hashes in a table: plain template, surface, kind, end of sentence, capital."""

    WORD, NUMBER, UNIT, NOTHING = range(4)

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.plain, self.surface = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)
        self.kind, self.ends, self.capital = np.zeros(1024, np.uint8), np.zeros(1024, bool), np.zeros(1024, bool)

    def add(self, raw: str) -> int:
        i = len(self.number)
        if i == len(self.plain):
            self.plain, self.surface, self.kind, self.ends, self.capital = (np.concatenate([x, np.zeros_like(x)]) for x in (self.plain, self.surface, self.kind, self.ends, self.capital))
        self.number[raw] = i
        core = raw
        while core and not (core[0].isalnum() or (len(core) > 1 and core[0] in "+-−$€£" and core[1].isdigit())):
            core = core[1:]
        while core and not (core[-1].isalnum() or core[-1] == "%" and core[-2:-1].isdigit()):
            core = core[:-1]
        low = core.lower()
        self.surface[i] = self.plain[i] = _hash(low)
        self.ends[i] = bool(re.search(r"[.!?…]['\"”»)]*$", raw))
        if not core:
            self.kind[i], self.surface[i] = self.NOTHING, _hash(raw)
        elif _NUMBER.match(core):
            self.kind[i], self.plain[i] = self.NUMBER, _NUM
        elif (m := _MEASURE.match(core)) and (m[2].lower() in UNITS or m[2][0] == "°"):
            self.kind[i], self.plain[i] = self.NUMBER, _NUM ^ _UNIT
        else:
            self.kind[i] = self.UNIT if low in UNITS else self.WORD
            self.capital[i] = core[0].isupper()
        return i


@cache
def _words() -> Words:
    return Words()


def views_of(text: str | None) -> tuple[list[int], np.ndarray, np.ndarray]:
    """The views of a text: their numbers, and a row for each with the hashes of its windows and the slot values per
    template word or 0.

    View 0 has placeholders for numbers and units; view 1, where the text has capitalised words inside sentences, for
    these too; view 2, where it has any, for all capitalised words. In a text of fewer words than a window all of them
    make the one window; a text without words has no view.
    """
    words = _words()
    if len(words.number) > CACHE_WORDS:
        words.clear()
    number = words.number
    raw = (text or "").split()
    at = np.array([number[w] if w in number else words.add(w) for w in raw], np.int64)
    kind = words.kind[at]
    ends = words.ends[at]
    starts = np.ones(len(at), bool)
    starts[1:] = ends[:-1]
    real = kind != Words.NOTHING
    if not real.all():
        # Bare punctuation is no word, but may end a sentence for the word that follows.
        at, kind, starts = at[real], kind[real], starts[real]
    if not len(at):
        return [], np.zeros((0, 0), np.uint64), np.zeros((0, 0), np.uint64)
    plain, surface = words.plain[at].copy(), words.surface[at]
    is_number = kind == Words.NUMBER
    unit = np.zeros(len(at), bool)
    unit[1:] = (kind[1:] == Words.UNIT) & is_number[:-1]
    plain[unit] = _UNIT
    typed = is_number | unit
    capital = words.capital[at] & ~unit
    views, names = [0], [np.zeros(len(at), bool)]
    if (inside := capital & ~starts).any():
        views, names = [*views, 1], [*names, inside]
    if capital.any():
        views, names = [*views, 2], [*names, capital]
    name = np.stack(names)
    h, slot = np.where(name, np.uint64(_NAME), plain), name | typed
    n = min(WINDOW, len(plain))
    m = len(plain) - n + 1
    rolled, filled = np.zeros((len(views), m), np.uint64), np.zeros((len(views), m), np.int8)
    for k in range(n):
        rolled = rolled * _BASE + h[:, k : m + k]
        filled += slot[:, k : m + k]
    # A window of almost nothing but placeholders says too little.
    rolled[filled > n - min(MIN_WORDS, n)] = 0
    return views, rolled, np.where(slot, surface, np.uint64(0))


def templates(text: str | None) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """The views of a text as a list: (view, hashes of its windows, slot values per template word or 0)."""
    return list(zip(*views_of(text), strict=True))


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse, modulo 2^64."""
    return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, x, np.uint64))]) for x in (_BASE, _INVERSE))


def _surfaces(text: str | None, trim: bool = False) -> np.ndarray:
    """Surface hashes of all words and free-standing signs; trimmed, without signs at either end."""
    words = _words()
    if len(words.number) > CACHE_WORDS:
        words.clear()
    number = words.number
    at = np.array([number[w] if w in number else words.add(w) for w in (text or "").split()], np.int64)
    if trim:
        real = np.flatnonzero(words.kind[at] != Words.NOTHING)
        at = at[real[0] : real[-1] + 1] if len(real) else at[:0]
    return words.surface[at]


def whole_windows(surfaces: np.ndarray, lengths: list[int]) -> list[int]:
    """Hashes of all windows of the given lengths, each once; any length costs the same."""
    n = len(surfaces)
    if not any(k <= n for k in lengths):
        return []
    power, inverse = (x[:n] for x in _powers(1 << n.bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(surfaces * inverse)])
    got = [(sums[k:] - sums[:-k]) * power[: n - k + 1] ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for k in lengths if k <= n]
    return np.unique(np.concatenate(got)).tolist()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _slots(values: np.ndarray, at: int) -> list[int]:
    return [_signed(int(v)) for v in values[at : at + WINDOW]]


_WINDOWS = "view int, hash bigint, at int, slots array<bigint>"


def benchmark_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Each item's template windows. View 2 counts only for items of which it leaves half of the windows usable: what is
    left of a title in capitals would be found in any text. An item without a usable window has one row in the view
    ``WHOLE``, with its length in place of the window's place."""

    def rows(ids: list, texts: list) -> list[tuple]:
        out = []
        for i, t in zip(ids, texts, strict=True):
            views = templates(t)
            # View 0 has the most usable windows.
            if views and not views[0][1].any():
                whole = _surfaces(t, trim=True)
                out += [(i, WHOLE, _signed(h), len(whole), []) for h in whole_windows(whole, [len(whole)])]
            for v, hs, slots in views:
                if v < 2 or 2 * np.count_nonzero(hs) >= len(hs):
                    out += [(i, v, _signed(int(h)), k, _slots(slots, k)) for k, h in enumerate(hs) if h]
        return out

    return by_row(benchmark, [item_id, text], f"item_id bigint, {_WINDOWS}", rows)


def _bitmap(bench: DataFrame) -> np.ndarray:
    """The set of the benchmark's hashes, modulo ``FILTER_BITS``, one bit each. Executors build it in blocks of 32,768 bits;
    at most ``FILTER_BITS`` / 8 bytes reach the driver, whatever the benchmark's size."""
    b = F.pmod("hash", F.lit(FILTER_BITS))
    blocks = bench.groupBy(F.shiftright(b, 15).alias("block")).agg(F.bitmap_construct_agg(b.bitwiseAND(F.lit(32_767))).alias("bits"))
    packed = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in blocks.collect():
        packed[r["block"] * 4096 : (r["block"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return packed


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", contained: float = CONTAINED) -> DataFrame:
    """Items found in documents: ``doc_id, row, item_id, coverage, verbatim`` (no slot value was changed).

    Null and empty texts hold and leak nothing; items of fewer words than a window have one window, of all words of the
    document too. Items without a usable window are found wherever they stand as a whole. Rows that share an id, or have
    none, are told apart by ``row``, the hash of their text; rows equal in both are one. Extra columns are not read.
    """
    spark = docs.sparkSession
    bench = settle(benchmark_windows(benchmark), "benchmark")
    lengths = sorted(r[0] for r in bench.filter(F.col("view") == WHOLE).select("at").distinct().collect())
    shared = spark.sparkContext.broadcast(_bitmap(bench))
    hashed = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), row_hash(F.col(text)).alias("row"), F.col(text).alias("text"))

    def rows(ids: list, hashes: list, texts: list) -> list[tuple]:
        packed = shared.value
        out = []
        for i, r, t in zip(ids, hashes, texts, strict=True):
            if lengths:
                whole = whole_windows(_surfaces(t), lengths)
                out += [(i, r, WHOLE, _signed(h), 0, []) for h in whole if packed[(h & FILTER_BITS - 1) >> 3] >> (h & 7) & 1]
            views, hs, slots = views_of(t)
            b = (hs & np.uint64(FILTER_BITS - 1)).astype(np.int64)
            hit = np.nonzero((packed[b >> 3] >> (b & 7).astype(np.uint8)) & 1 & (hs != 0))
            out += [(i, r, views[v], _signed(int(hs[v, k])), int(k), _slots(slots[v], k)) for v, k in zip(*hit, strict=True)]
        return out

    found = by_row(hashed, ["doc_id", "row", "text"], f"doc_id bigint, row bigint, {_WINDOWS}", rows)
    b = bench.select("item_id", "view", "hash", F.col("at").alias("item_at"), F.col("slots").alias("item_slots"))
    met = found.join(b, ["view", "hash"]).withColumn("shift", F.col("at") - F.col("item_at"))
    # A run: one item in one document at one shift. Its slot pairs must be a function of the item's value.
    pairs = F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d"))
    pairs = F.filter(pairs, lambda p: p["i"] != 0)
    runs = met.groupBy("doc_id", "row", "item_id", "view", "shift").agg(F.collect_set("item_at").alias("places"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"))
    # Words put in or left out shift what follows: the runs of an item and a document are taken together, the largest
    # first, and one that contradicts those before it is left out.
    runs = runs.filter(_function("pairs")).groupBy("doc_id", "row", "item_id", "view").agg(F.sort_array(F.collect_list(F.struct(F.size("places").alias("size"), (-F.abs("shift")).alias("near"), "places", "pairs")), asc=False).alias("runs"))
    none = F.struct(F.array().cast("array<int>").alias("places"), F.array().cast("array<struct<i:bigint,d:bigint>>").alias("pairs"))
    both = lambda x, y: F.struct(F.array_union(x["places"], y["places"]).alias("places"), F.array_union(x["pairs"], y["pairs"]).alias("pairs"))
    taken = F.aggregate("runs", none, lambda x, y: F.when(_function(F.array_union(x["pairs"], y["pairs"])), both(x, y)).otherwise(x))
    places = runs.select("doc_id", "row", "item_id", "view", taken.alias("t")).select("doc_id", "row", "item_id", "view", F.size("t.places").alias("n"), F.forall("t.pairs", lambda p: p["i"] == p["d"]).alias("verbatim"))
    sizes = bench.groupBy("item_id", "view").agg(F.countDistinct("at").alias("windows"))
    share = (F.col("n") / F.col("windows")).alias("coverage")
    scored = places.join(sizes, ["item_id", "view"]).select("doc_id", "row", "item_id", share, "verbatim").filter(F.col("coverage") >= contained)
    return scored.groupBy("doc_id", "row", "item_id").agg(F.max("coverage").alias("coverage"), F.bool_or("verbatim").alias("verbatim"))


def _function(pairs) -> Column:
    """Whether every item value has one document value."""
    pairs = F.col(pairs) if isinstance(pairs, str) else pairs
    return F.size(pairs) == F.size(F.array_distinct(F.transform(pairs, lambda p: p["i"])))


def report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: whether it leaks, how many items, the smallest of them, the best coverage."""
    found = leaks(docs, benchmark, doc_id, text).groupBy("doc_id", "row").agg(
        F.count("*").alias("n_items"), F.min("item_id").alias("item_id"), F.round(F.max("coverage"), 6).alias("coverage"), F.bool_and("verbatim").alias("verbatim")
    )
    d, f = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), row_hash(F.col(text)).alias("row")).alias("d"), found.alias("f")
    out = d.join(f, F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.row") == F.col("f.row")), "left")
    return out.select(
        "d.doc_id", F.col("f.n_items").isNotNull().alias("contaminated"), F.coalesce("f.n_items", F.lit(0)).alias("n_items"), "f.item_id", F.coalesce("f.coverage", F.lit(0.0)).alias("coverage"), "f.verbatim"
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns, whatever their names. Of rows that share an id, or have
    none, only those whose own text holds an item go."""
    of, row = fresh_name(docs, "of"), fresh_name(docs, "row")
    found = leaks(docs, benchmark, doc_id, text).select(F.col("doc_id").alias(of), F.col("row").alias(row)).distinct()
    return docs.join(found, F.col(doc_id).cast("bigint").eqNullSafe(F.col(of)) & (row_hash(F.col(text)) == F.col(row)), "left_anti")
