"""SimHash, components and line dedup against brute force."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from terrace.llm import linededup, simhash
from terrace.llm.components import components


def slow_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in "".join(" " if c in "\t\n\r\x0b\x0c" else c for c in low).split(" ") if x]
    if not w:
        return 0
    s = [" ".join(w)] if len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", "  \n", "One", "one TWO", "É é A b C d", "a b c a b c a b c", "x y z\tq w"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_print(text)


def test_golay_code_is_perfect():
    code, leader = simhash.golay()
    assert min(bin(int(x)).count("1") for x in code[1:]) == 7 and len(set(code.tolist())) == 4096
    assert sorted(bin(int(x)).count("1") for x in leader) == [0] + [1] * 23 + [2] * 253 + [3] * 1771
    rng = random.Random(0)
    for _ in range(200):
        w = rng.getrandbits(23)
        near = [i for i, c in enumerate(code.tolist()) if bin(c ^ w).count("1") <= 4]
        assert sorted(simhash.near_codewords(w)) == near


def test_all_close_pairs_share_a_key():
    rng = random.Random(1)
    for _ in range(3000):
        a = rng.getrandbits(64)
        b = a ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        (ia, _), (ib, pb) = simhash.fuzzy_keys(a), simhash.fuzzy_keys(b)
        assert set(ia) & set(ib + pb)


def classes(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("hot", [2, 48])
def test_links_have_the_components_of_all_close_pairs(spark, hot):
    """With hot = 2 almost every key goes the second way; both ways must give the same classes."""
    rng = random.Random(2)
    prints = set()
    for _ in range(25):
        base = rng.getrandbits(64)
        for _ in range(12):
            prints.add(base ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(4))}))
    base = rng.getrandbits(64)
    prints |= {base ^ (1 << i) ^ (1 << j) for i in range(10) for j in range(i)}
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = simhash.near_links(df, hot=hot)
    got = {r.node: r.root for r in components(links).collect()}
    close = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if bin((a ^ b) & (2**64 - 1)).count("1") <= 2]
    want = classes(signed, close)
    assert {n: got.get(n, n) for n in signed} == want


def test_components_of_long_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


WORDS = "the old mill by river bend was sold to a quiet man who never spoke of it again".split()


def test_near_duplicates_end_to_end(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(300)) for _ in range(6)]
    docs = []
    for t in base:
        docs += [t, t, t + " x", t.upper(), " ".join(t.split()[1:])]
    rows = [(10 + i, t) for i, t in enumerate(docs)] + [(1, None), (2, ""), (3, " \n"), (4, "word"), (4, "word"), (None, docs[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(0))
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    fps = [(d, slow_print(t)) for d, t in rows]
    nodes = sorted({f for _, f in fps})
    c = classes(nodes, [(a, b) for i, a in enumerate(nodes) for b in nodes[:i] if bin(a ^ b).count("1") <= 2])
    low = {}
    for d, f in fps:
        if d is not None:
            low[c[f]] = min(d, low.get(c[f], d))
    want = sorted((str(d), f"{f:016x}", low[c[f]]) for d, f in fps)
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want
    kept = simhash.keep_one(df).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(low.values())) and kept[0].asDict().keys() == set(df.columns)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_one_row_of_each_class_stays(spark):
    """Shared and null ids, equal rows, and columns named like helpers."""
    a, b, c = ("one two three four five six", "quite another text about rivers and mills", "a third that nobody has copied")
    rows = [(1, a), (1, a), (1, b), (1, b), (None, a), (None, c), (None, c), (2, b), (None, None), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({x: F.lit("x") for x in ("of", "_of", "row", "fp", "best", "root")})
    kept = simhash.keep_one(df).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == sorted([("1", a), ("1", b), ("None", c), ("3", "None")])
    assert simhash.keep_one(df).columns == df.columns and simhash.keep_one(df.limit(0)).count() == 0


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        e = [i]
        for j, y in enumerate(b, 1):
            e.append(min(d[j] + 1, e[-1] + 1, d[j - 1] + (x != y)))
        d = e
    return d[-1]


def change(rng, a, k, letters="abcé"):
    a = list(a)
    for _ in range(k):
        kind, i = rng.randrange(3), rng.randrange(len(a) + 1)
        if kind == 0:
            a.insert(i, rng.choice(letters))
        elif a:
            a[min(i, len(a) - 1) : min(i, len(a) - 1) + 1] = [] if kind == 1 else [rng.choice(letters)]
    return "".join(a)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_banded_distance(spark, most):
    rng = random.Random(most)
    pairs = []
    for _ in range(700):
        a = "".join(rng.choice("abcé") for _ in range(rng.choice([0, 1, 2, 6, 7, 8, 9, 12, 33, 64, 65, 90])))
        pairs.append((a, change(rng, a, rng.randrange(6))))
    pairs.append((None, "x"))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", linededup.edit_distance(F.col("a"), F.col("b"), most).alias("d")).collect()
    for r in got:
        assert r.d == (None if r.a is None else min(most + 1, edits(r.a, r.b))), (r.a, r.b)


def row_hash(text):
    x = xxhash.xxh64_intdigest(text.encode(), 42)
    return x - (1 << 64) if x >> 63 else x


def slow_drops(docs, least=32):
    """Every line that goes, as (id, text, line number, near)."""
    places = {((d is not None, d or 0), row_hash(t), k, t, x.strip(" ").lower()) for d, t in docs if t is not None for k, x in enumerate(t.split("\n")) if len(x.strip(" ")) >= least}
    first = {}
    for d, r, k, t, x in sorted(places):
        first.setdefault(x, (d, r, k))
    out = set()
    for d, r, k, t, x in places:
        again = first[x] < (d, r, k)
        near = any(at < first[x] and y != x and abs(len(x) - len(y)) <= 2 and edits(x, y) <= 2 for y, at in first.items())
        if again or near:
            out.add((d[1] if d[0] else None, t, k, not again))
    return out


def rest_of(d, t, gone):
    return None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if not {(d, t, k, True), (d, t, k, False)} & gone)


@pytest.mark.parametrize("hot", [1, linededup.HOT])
def test_line_dedup_against_all_pairs(spark, hot):
    """With hot = 1 every key is crowded, so all links come from groups."""
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(33, 70))).strip() for _ in range(40)]
    lines = [change(rng, rng.choice(base), rng.randrange(4), "xyz é") for _ in range(260)] + ["short"] * 20
    rng.shuffle(lines)
    docs = []
    while lines:
        k = rng.randrange(1, 6)
        docs.append((len(docs), "\n".join(lines[:k])))
        lines = lines[k:]
    docs += [(900, None), (901, ""), (None, docs[0][1]), (902, docs[3][1].upper()), (903, "\n".join([base[0]] * 3))]
    # Rows that share an id, or have none, with lines of their own at the same places.
    own = ["".join(rng.choice("mnopqrst ") for _ in range(50)).strip() for _ in range(4)]
    docs += [(904, f"{base[1]}\n{own[0]}"), (904, f"{base[1]}x\n{own[1]}"), (None, f"{own[2]}\n{base[2]}"), (None, f"{base[2]}y\n{own[3]}"), (904, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("at", "near", "of", "_of", "row", "gone", "_gone", "h", "key")})
    want = slow_drops(docs)
    texts_of = {(d, row_hash(t)): t for d, t in docs if t is not None}
    got = {(r.doc_id, texts_of[r.doc_id, r.row], r["at"], r.near) for r in linededup.dropped(df, hot=hot).collect()}
    assert got == want
    out = linededup.without_repeated_lines(df, hot=hot)
    assert out.columns == df.columns
    left = sorted((str(r.doc_id), str(r.text)) for r in out.collect())
    assert left == sorted((str(d), str(rest_of(d, t, want))) for d, t in docs)
    assert all(any(o in t for _, t in left) for o in own)
    report = linededup.line_report(df, hot=hot).collect()
    assert len(report) == len(docs) and sum(r.n_equal + r.n_near for r in report) == len(want)
    rows = {r.doc_id: r for r in report}
    assert rows[900].n_lines == 0 and rows[901].n_lines == 1
    keys = {x.strip(" ").lower() for _, t in docs if t for x in t.split("\n") if len(x.strip(" ")) >= 32}
    degree = {x: sum(x != y and abs(len(x) - len(y)) <= 2 and edits(x, y) <= 2 for y in keys) for x in keys}
    for d, t in docs[:30]:
        links = sum(degree.get(x.strip(" ").lower(), 0) for x in t.split("\n"))
        assert rows[d].n_links == links if hot > 1 else (rows[d].n_links > 0) == (links > 0) and rows[d].n_links <= links


@pytest.mark.parametrize("base", ["page of the book that was read in the year", "a" * 40])
def test_large_groups_of_near_lines(spark, base):
    """Hundreds of lines with one or two changes each, at all places, and some with three: the same result as all pairs."""
    rng = random.Random(len(set(base)))
    lines = {base} | {change(rng, base, rng.choice([1, 1, 2, 3]), "abxé") for _ in range(160)}
    lines |= {f"{base} number {i:03}" for i in range(0, 1000, 13)}
    docs = [(i, t) for i, t in enumerate(rng.sample(sorted(lines), len(lines)))]
    got = {(r.doc_id, r.near) for r in linededup.dropped(spark.createDataFrame(docs, "doc_id long, text string"), hot=8).collect()}
    assert got == {(d, near) for d, _, _, near in slow_drops(docs)}


def test_groups_hold_no_pair_that_is_too_far(spark):
    rng = random.Random(7)
    lines = sorted({change(rng, "ab" * 20, rng.randrange(5), "abc") for _ in range(120)})
    df = spark.createDataFrame([(x,) for x in lines], "line string").select((F.xxhash64("line").bitwiseAND(F.lit(-2))).alias("h"), "line")
    links, groups = linededup.near_links(df, hot=2)
    name = {r.h: r.line for r in df.collect()}
    met = {frozenset((name[r.a], name[r.b])) for r in links.collect()}
    by_group = {}
    for r in groups.collect():
        by_group.setdefault(r.g, []).append(name[r.h])
    for g in by_group.values():
        met |= {frozenset((a, b)) for i, a in enumerate(g) for b in g[:i]}
    assert met == {frozenset((a, b)) for i, a in enumerate(lines) for b in lines[:i] if edits(a, b) <= 2}


def test_near_texts(spark):
    rng = random.Random(1)
    pairs = [(a, change(rng, a, rng.randrange(5))) for a in ("".join(rng.choice("abcé") for _ in range(rng.choice([0, 1, 2, 9, 33, 90]))) for _ in range(400))]
    for r in spark.createDataFrame(pairs, "a string, b string").select("a", "b", linededup.near(F.col("a"), F.col("b")).alias("near")).collect():
        assert r.near == (edits(r.a, r.b) <= 2), (r.a, r.b)


def test_line_dedup_of_repeated_rows_and_nothing(spark):
    line = "one line that is certainly long enough to take part"
    df = spark.createDataFrame([(1, line), (1, line)], "doc_id long, text string")
    assert [r.text for r in linededup.without_repeated_lines(df).collect()] == [line, line]
    assert linededup.line_report(df.limit(0)).count() == 0
    assert linededup.without_repeated_lines(df.limit(0)).count() == 0
    long = " ".join(f"{line} {i}" for i in range(4000))
    rows = [(1, f"{long} end\n{line}"), (2, f"{long} and"), (3, line)]
    got = {r.doc_id: r.text for r in linededup.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "", 3: ""}
