"""The Merkle manifest against a plain tree."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from terrace.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def digest(row, lower=False):
    row = list(row)
    if lower and row[4] is not None:
        row[4] = "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(nodes):
    """Levels of a tree, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def steps(levels, rank):
    """The siblings on both sides, level by level."""
    out = []
    for level in levels[:-1]:
        at = rank - rank % 8
        out.append(("".join(level[at:rank]), "".join(level[rank + 1 : at + 8])))
        rank //= 8
    return out


def brute(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    low = {}
    for lang in langs:
        trees[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))
        low[lang] = climb([digest(r) for r in trees[lang]])
    top = climb([low[x][-1][0] for x in langs])
    out = []
    for t, lang in enumerate(langs):
        for k, r in enumerate(trees[lang]):
            path = steps(low[lang], k) + steps(top, t)
            at = digest(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0)
            for left, right in path:
                at = h(left, at, right)
            root = top[-1][0]
            out.append((str(r[0]), digest(r), low[lang][-1][0], root, h(*[a + b for a, b in path]), at, at == root))
    return sorted(out)


def got(spark, rows, extra=True):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        df = df.selectExpr("*", "1 as tree", "2 as n", "3 as rank", "'x' as leaf", "'y' as digest", "4 as _at", "5 as changed")
    return sorted((str(r[0]), *r[1:]) for r in merkle.manifest(df).collect())


@pytest.mark.parametrize("size", [1, 2, 8, 9, 65, 700])
def test_trees_of_every_height(spark, size):
    rows = [(i * 7 % 1009, f"s{i % 3}", "en", i, f"Text Ä {i}") for i in range(size)]
    assert got(spark, rows) == brute(rows)


def test_many_languages_nulls_and_repeats(spark):
    rows = [(i, None, lang, None, text) for i, (lang, text) in enumerate([(None, "A"), ("", ""), ("é", None), ("z", "LONE"), ("ab", "x" * 100_000)])]
    rows += [(i % 50, "s", f"l{i % 13}", i % 2, "Same") for i in range(300)] + [(5, "s", "hot", 1, "Repeated Row")] * 70 + [(None, "s", "hot", 1, "no id"), (None, None, None, None, None)]
    out = got(spark, rows)
    assert out == brute(rows)
    assert {r[-1] for r in out} == {True, False}


def test_the_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_some_leaves_only_and_the_store(spark):
    """Requests for a few leaves meet a few nodes; every record is its children's digest."""
    rows = [(i, "s", ("en", "de")[i % 9 == 0], 1, f"t{i}") for i in range(600)]
    m = merkle.build(spark.createDataFrame(rows, SCHEMA))
    assert all(r.digest == h(*r.children) and len(r.children) <= 8 for r in m.store.collect())
    some = m.leaves.filter(F.col("doc_id").isin(0, 17, 599))
    found = merkle.proofs(m, some).withColumn("at", merkle.folded(F.col("leaf"), F.col("path"))).collect()
    assert sorted(r.doc_id for r in found) == [0, 17, 599]
    assert all(r.at == m.root and r.digest == r.leaf for r in found)
