"""Merkle manifest of a data set: a content-addressed DAG of digests, and proofs by descending it.

Building goes upwards: the leaves of a tree are ranked, and every eight consecutive nodes become the digest of their
digests, one grouping a level. What is stored is one record per distinct node, digest to children; a proof needs neither
parents nor places. Proving goes downwards: requests start at the root and follow the digits (base eight) of their rank;
at each record the child under the digit is followed and the children beside it are collected. Requests that share their
first digits share one row on the way, so the joins meet every node once however many leaves lie below it; only in the
last step, inside the row of the leaves' parent, does each leaf get its own path. A path runs from root to leaf; turned
round, its segments are the proof.

The trees of the languages hang below one more tree, over their roots.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.llm.common import settle

#: Bits of a digit of a rank: eight children a node.
BITS = 3
WAYS = 1 << BITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left:string,right:string>>"


def leaf_digest(fields: list[Column]) -> Column:
    """Lowercase hex SHA-256 over the fields, each ``-`` if null, else the number of its UTF-8 bytes, a colon, the value."""
    text = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in text]), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def depth_of(n: Column) -> Column:
    """Levels above the leaves in a tree of ``n``: the digits of its last rank, none for a lone leaf."""
    bits = F.length(F.conv((n - 1).cast("string"), 10, 2))
    return F.when(n <= 1, 0).otherwise(F.ceil(bits / BITS)).cast("int")


def ranked(df: DataFrame, tree: str, order: list[str], name: str) -> DataFrame:
    """The rows with their ``rank`` (from 0, nulls first) in their tree and the tree's size ``n``.

    Rows are dealt to sorted ranges and written; a row's place in its range, and the rows of its tree in the ranges
    before, give its rank. No task sees a whole tree: only a row per range and tree goes through a window.
    """
    dealt = df.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    placed = settle(dealt.withColumn("_at", F.monotonically_increasing_id()), f"{name}-places")
    part = F.shiftrightunsigned("_at", 33)
    runs = placed.groupBy(part.alias("_part"), F.col(tree).alias("_tree")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    of_tree = Window.partitionBy("_tree")
    before = F.coalesce(F.sum("_rows").over(of_tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Written, so that Spark knows its size when it chooses the join.
    starts = settle(runs.select("_part", "_tree", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(of_tree).alias("n")), f"{name}-starts")
    both = placed.join(starts, (part == F.col("_part")) & (F.col(tree) == F.col("_tree")))
    return both.select(*df.columns, (F.col("_at") + F.col("_shift")).alias("rank"), "n")


def grow(leaves: DataFrame, name: str) -> tuple[DataFrame, DataFrame, int]:
    """Of leaves ``tree, n, rank, digest``: the store ``level, digest, children``, the roots ``tree, n, digest`` and the
    most levels that a tree has. A lone leaf is its own root."""
    most = leaves.agg(F.max(depth_of(F.col("n")))).first()[0] or 0
    level = leaves.select("tree", "n", "rank", "digest")
    roots = level.filter("n = 1").select("tree", "n", "digest")
    store = level.limit(0).select(F.lit(0).alias("level"), "digest", F.array("digest").alias("children"))
    for k in range(1, most + 1):
        # At most eight rows a group.
        groups = level.filter(depth_of(F.col("n")) >= k).groupBy("tree", "n", F.shiftright("rank", BITS).alias("rank"))
        family = groups.agg(F.array_sort(F.collect_list(F.struct((F.col("rank") % WAYS).alias("digit"), "digest"))).alias("family"))
        node = family.select("tree", "n", "rank", F.col("family.digest").alias("children"))
        level = settle(node.withColumn("digest", F.sha2(F.concat_ws("", "children"), 256)), f"{name}-{k}")
        store = store.unionByName(level.select(F.lit(k).alias("level"), "digest", "children"))
        roots = roots.unionByName(level.filter(depth_of(F.col("n")) == k).select("tree", "n", "digest"))
    return store.dropDuplicates(["digest"]), roots, most


def _segment(digit: Column) -> Column:
    """What stands on both sides of the chosen child, digests run together."""
    side = lambda start, length: F.array_join(F.slice("children", start, length), "")
    return F.struct(side(F.lit(1), digit).alias("left"), side(digit + 2, F.lit(WAYS)).alias("right"))


def descend(store: DataFrame, starts: DataFrame, requests: DataFrame, most: int, name: str) -> DataFrame:
    """Each request (``tree, n, rank`` and more columns) with the ``digest`` found at its rank, its ``path`` from the
    root, and its tree's ``root``.

    ``starts`` has a row per tree: ``tree, n, digest, path``, the path being the one that leads to its root. The rows of
    a level are the prefixes of wanted ranks, each once; they meet the store by digest. Requests are asked for once each.
    """
    entering = starts.select("tree", "n", F.lit(0).cast("bigint").alias("rank"), "digest", "path", F.col("digest").alias("root"))
    extra = [c for c in requests.columns if c not in ("tree", "n", "rank")]
    front = None
    for k in range(most, 0, -1):
        new = entering.filter(depth_of(F.col("n")) == k)
        front = new if front is None else front.unionByName(new)
        met = front.join(store.filter(F.col("level") == k).select("digest", "children"), "digest")
        if k == 1:
            break
        wanted = requests.select("tree", F.shiftright("rank", BITS * (k - 1)).alias("rank")).distinct()
        child = met.select("tree", "n", "rank", "path", "root", "children", F.posexplode("children").alias("digit", "digest"))
        step = child.select("tree", "n", (F.col("rank") * WAYS + F.col("digit")).alias("rank"), "digest", F.concat("path", F.array(_segment(F.col("digit")))).alias("path"), "root")
        front = settle(step.join(wanted, ["tree", "rank"], "left_semi"), f"{name}-{k}")
    alone = requests.filter("n = 1").join(starts.select("tree", "digest", "path", F.col("digest").alias("root")), "tree").select(*extra, "digest", "path", "root")
    if front is None:
        return alone
    family = requests.filter("n > 1").groupBy("tree", F.shiftright("rank", BITS).alias("rank")).agg(F.collect_list(F.struct((F.col("rank") % WAYS).cast("int").alias("digit"), *extra)).alias("family"))
    below = met.join(family, ["tree", "rank"]).select("children", "path", "root", F.explode("family").alias("f"))
    digit = F.col("f.digit")
    found = below.select(*[F.col(f"f.{c}").alias(c) for c in extra], F.get("children", digit).alias("digest"), F.concat("path", F.array(_segment(digit))).alias("path"), "root")
    return found.unionByName(alone)


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, from leaf to root."""
    return F.sha2(F.concat_ws("", F.transform(F.reverse(path), lambda s: F.concat(s["left"], s["right"]))), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(F.reverse(path), leaf, lambda at, s: F.sha2(F.concat(s["left"], at, s["right"]), 256))


@dataclass
class Manifest:
    leaves: DataFrame  # tree, n, rank, doc_id, leaf, changed
    store: DataFrame  # level, digest, children
    trees: DataFrame  # tree, n, digest, path: the languages' roots and the paths that lead to them
    root: str | None
    levels: int


def build(docs: DataFrame, changed: Column | None = None) -> Manifest:
    """Manifest of a table with the five fields. Where the condition ``changed`` holds (over those columns), the
    leaves also carry the digest of the row with its text in lower case, to try the proofs on."""
    rows = docs.select(*FIELDS)
    leaf = leaf_digest([F.col(c) for c in FIELDS])
    other = leaf_digest([lower_ascii(F.col(c)) if c == "text" else F.col(c) for c in FIELDS])
    where = F.lit(False) if changed is None else F.coalesce(changed, F.lit(False))
    hashed = rows.select("lang", "doc_id", leaf.alias("leaf"), F.when(where, other).otherwise(leaf).alias("changed"))
    hashed = settle(hashed, "leaves")
    langs = ranked(hashed.select("lang", F.lit(0).cast("bigint").alias("tree")).distinct(), "tree", ["lang"], "langs")
    langs = settle(langs.select("lang", F.col("rank").alias("place"), F.col("n").alias("among")), "langs")
    # One row per language: Spark knows the size of the written table.
    own = hashed.join(langs, hashed["lang"].eqNullSafe(langs["lang"])).select(F.col("place").alias("tree"), "doc_id", "leaf", "changed")
    leaves = settle(ranked(own, "tree", ["doc_id", "leaf"], "leaves"), "ranked")
    store, roots, levels = grow(leaves.withColumnRenamed("leaf", "digest"), "level")
    tops = roots.join(langs, roots["tree"] == langs["place"]).select(F.lit(0).cast("bigint").alias("tree"), F.col("among").alias("n"), F.col("place").alias("rank"), "digest", F.col("n").alias("_n"))
    tops = settle(tops, "roots")
    upper, one, high = grow(tops, "top")
    first = one.first()
    start = one.withColumn("path", F.array().cast(_PATH))
    ways = descend(upper, start, tops.select("tree", "n", "rank", F.col("rank").alias("place"), "_n"), high, "top-path")
    trees = settle(ways.select(F.col("place").alias("tree"), F.col("_n").alias("n"), "digest", "path"), "trees")
    return Manifest(leaves, settle(store, "store"), trees, first["digest"] if first else None, levels)


def proofs(m: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """``doc_id, leaf, changed, digest, path, root`` of the requested leaves (rows of ``m.leaves``; all by default);
    ``root`` is that of the language, ``path`` leads from the top root to the leaf."""
    return descend(m.store, m.trees, m.leaves if requests is None else requests, m.levels, "path")


def manifest(docs: DataFrame) -> DataFrame:
    """One row per document: leaf, roots, digest of its proof, and the root that its row gives, changed where 3 divides
    the crc32 of the id.

    Nulls are written as ``-``; a null language is a tree of its own, first of all; a null id comes first in its tree and
    is never changed. Rows that share an id are ordered by their leaf; equal rows are neighbours, each with its own
    proof. Extra columns are not read. An empty table has no root and gives no rows.
    """
    m = build(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)
    got = proofs(m).select("doc_id", "leaf", F.col("root").alias("subroot"), F.lit(m.root).alias("root"), proof_digest(F.col("path")).alias("proof_sha256"), folded(F.col("changed"), F.col("path")).alias("folded_root"))
    return got.withColumn("verified", F.col("folded_root") == F.col("root"))
