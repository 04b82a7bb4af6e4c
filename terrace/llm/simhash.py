"""SimHash near-duplicates found by Golay-code fuzzy hashing.

The 64 bits fall into three segments of 22, 21 and 21 bits, each read as a word of the perfect binary Golay code
[23, 12, 7] with zeros in front. Two fingerprints that differ in two bits at most have one segment without an error and,
of the other two, whichever is chosen beforehand by the cycle below has one error at most:

* no error in segment s, and the errors fall (1, 1): the chosen one has one error;
* both errors fall in one segment: of the two clean segments, one has the other clean one as its choice.

The clean segment is an exact key. The chosen one is decoded to codewords: a word stands within three bits of exactly
one codeword, and a word one bit away lies within four bits of it. So every fingerprint is indexed under its own
codeword and probes with the (one to six) codewords within four bits; what meets is verified on all 64 bits.

A key under which more fingerprints stand than ``HOT`` is left to an exact second way that emits no pairs: two
fingerprints lie within two bits of each other just when some 64-bit word lies within one bit of both, so each member
of a hot key is written under its 65 such words, and words shared by several members link them to the smallest.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import by_row, fresh_name, settle
from terrace.llm.components import components

WORDS, ERRORS, HOT = 3, 2, 48
#: (shift, bits) of each segment; segment s is exact while segment (s + 1) % 3 is decoded.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
_GENERATOR = 0b101011100011


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64-bit majority of the XXH64 hashes (seed 42) of all word shingles; 0 without words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    joined = [b" ".join(w)] if len(w) < words else list(map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, 42) for s in joined], ">u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 65_536):
        part = h[k : k + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


@cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """The 4,096 codewords of 23 bits, and for every 11-bit syndrome the error pattern of at most three bits."""

    def rest(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= _GENERATOR << (i - 11)
        return x

    code = np.array([(m << 11) | rest(m << 11) for m in range(4096)], np.int64)
    single = [rest(1 << i) for i in range(23)]
    leader = np.zeros(2048, np.int64)
    for i in range(23):
        leader[single[i]] = 1 << i
        for j in range(i):
            leader[single[i] ^ single[j]] = 1 << i | 1 << j
            for k in range(j):
                leader[single[i] ^ single[j] ^ single[k]] = 1 << i | 1 << j | 1 << k
    return code, leader


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the low and high halves of a 23-bit word; xor of both gives the word's syndrome."""
    code, _ = golay()
    parity = code & 2047
    high = parity[np.arange(4096)]  # the upper 12 bits are the message
    return high, np.arange(2048)


def own_codeword(words: np.ndarray) -> np.ndarray:
    """Index of the one codeword within three bits of each word."""
    high, low = _tables()
    _, leader = golay()
    syndrome = high[words >> 11] ^ low[words & 2047]
    return (words ^ leader[syndrome]) >> 11


def near_codewords(word: int) -> list[int]:
    """Indices of all codewords within four bits of a word: its own first, then those of the words one bit away."""
    flips = np.array([word] + [word ^ (1 << i) for i in range(23)], np.int64)
    return list(dict.fromkeys(own_codeword(flips).tolist()))


def fuzzy_keys(fp: int) -> tuple[list[int], list[int]]:
    """Index keys (one per segment) and further probe keys of a fingerprint. A key holds its segment number, the exact
    segment and a codeword index."""
    index, probe = [], []
    for s, (shift, bits) in enumerate(SEGMENTS):
        exact = fp >> shift & ((1 << bits) - 1)
        shift2, bits2 = SEGMENTS[(s + 1) % 3]
        near = near_codewords(fp >> shift2 & ((1 << bits2) - 1))
        keys = [(s << 34 | exact << 12 | c) for c in near]
        index.append(keys[0])
        probe += keys[1:]
    return index, probe


def near_links(prints: DataFrame, errors: int = ERRORS, hot: int = HOT) -> DataFrame:
    """Links ``a, b`` whose components are those of "differ in ``errors`` = 2 bits at most" over distinct ``fp``."""
    keyed = by_row(prints, ["fp"], "fp bigint, index array<bigint>, probe array<bigint>", lambda fps: [(f, *fuzzy_keys(f & (2**64 - 1))) for f in fps])
    keyed = settle(keyed, "keys")
    index = keyed.select("fp", F.explode("index").alias("key"))
    probe = index.unionByName(keyed.select("fp", F.explode("probe").alias("key")))
    sizes = index.groupBy("key").agg(F.count("*").alias("n"))
    # A key under which only one fingerprint stands still meets probes; crowded keys go the second way.
    crowded = settle(sizes.filter(F.col("n") > hot).select("key"), "crowded")
    calm = index.join(crowded, "key", "left_anti")
    a, b = calm.alias("a"), probe.alias("b")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") != F.col("b.fp")) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= errors))
    pairs = met.select(F.greatest("a.fp", "b.fp").alias("a"), F.least("a.fp", "b.fp").alias("b")).distinct()
    # Everything that would have met under a crowded key, as itself and as its 64 neighbours.
    members = probe.join(crowded, "key", "left_semi").select("fp").distinct()
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit((1 << i) - ((1 << 64) if i == 63 else 0)).cast("bigint") for i in range(64)])
    near = members.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("word"))
    # At most 65 fingerprints share a word, all within two bits of each other.
    low = near.groupBy("word").agg(F.min("fp").alias("b"), F.collect_set("fp").alias("all")).filter(F.size("all") > 1)
    second = low.select(F.explode("all").alias("a"), "b").filter("a <> b").distinct()
    return pairs.unionByName(second)


def _prints(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, row, fp``: each document's fingerprint, and the hash of its text as the row's second key."""

    def rows(ids: list, hashes: list, texts: list) -> list[tuple]:
        return [(i, r, f - (1 << 64) if f >> 63 else f) for i, r, f in zip(ids, hashes, map(fingerprint, texts), strict=True)]

    given = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), _row(doc_id, text).alias("row"), F.col(text).alias("text"))
    return settle(by_row(given, ["doc_id", "row", "text"], "doc_id bigint, row bigint, fp bigint", rows), "prints")


def _row(doc_id: str, text: str) -> Column:
    """Never null: with the id, or 0 for none, it tells rows apart."""
    return F.xxhash64(F.col(doc_id).isNull(), F.col(text).isNull(), F.col(text))


def _classes(marked: DataFrame) -> DataFrame:
    """``fp, root, best``: every fingerprint's component and first row: ``none`` (no id), ``doc_id, row``."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")
    nodes = settle(marked.groupBy("fp").agg(first), "nodes")
    # Only nodes with a link have a root.
    roots = components(near_links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    return nodes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "best")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: fingerprint (16 hex digits) and the smallest id that is reachable over links.

    Null and empty texts have fingerprint zero and link like any other. Equal fingerprints are one node however many
    documents have them, so a hot group costs one node. Repeated rows give repeated rows; a null id counts as no id when
    the smallest is sought. Extra columns are not read.
    """
    marked = _prints(docs, doc_id, text)
    classes = settle(_classes(marked), "classes")
    lowest = classes.groupBy("root").agg(F.min("best.doc_id").alias("component_id"))
    named = classes.join(lowest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component: the row with the smallest id, with all its columns, whatever their names.

    Of rows that share this id, one with the smallest hash of its text stays; of rows equal in id and text, one. A row
    without an id stays only where its component has no id at all, and then one.
    """
    of, row = fresh_name(docs, "of"), fresh_name(docs, "row")
    best = _classes(_prints(docs, doc_id, text)).groupBy("root").agg(F.min("best").alias("best"))
    chosen = best.select(F.coalesce("best.doc_id", F.lit(0)).alias(of), F.col("best.row").alias(row))
    keyed = docs.withColumns({of: F.coalesce(F.col(doc_id).cast("bigint"), F.lit(0)), row: _row(doc_id, text)})
    return keyed.join(chosen, [of, row], "left_semi").dropDuplicates([of, row]).select(*docs.columns)
