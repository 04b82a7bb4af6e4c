"""Suffix-array dedup against a dictionary of all 50-byte strings."""

import hashlib
import random

import numpy as np
import pytest

from terrace.llm import suffixes

SCHEMA = "doc_id long, text string"


def brute(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49) if i is not None else ():
            s = b[p : p + 50]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 49) if i is not None else ():
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        runs = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(b) else 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]]) if len(b) else b""
        out.append((str(i), len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as row", "2 as starts", "'x' as data", "3 as chunk", "4 as grp", "5 as hashes").repartition(3)
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.without_repeats(df).collect())


@pytest.mark.parametrize("size", [*range(1, 12), 100, 3000])
@pytest.mark.parametrize("letters", [1, 2, 200])
def test_suffix_order(size, letters):
    s = np.random.default_rng(size).integers(1, letters + 1, size)
    text = tuple(s.tolist())
    assert suffixes.suffix_order(s, 10**9).tolist() == sorted(range(size), key=lambda i: text[i : i + 3000])
    short = [text[i : i + 50] for i in suffixes.suffix_order(s, 50).tolist()]
    assert short == sorted(short)


def test_pieces_tile_the_windows():
    """Every window has one piece, with the same anchor and hash wherever it stands."""
    rng = random.Random(3)
    docs = ["".join(rng.choice("ab ") for _ in range(n)).encode() for n in (0, 49, 50, 400, 51)] + [b"a" * 200, b""]
    docs += [docs[3][100:300], b"x" + docs[3][77:180]]
    data, ends = np.frombuffer(b"".join(docs), np.uint8), np.cumsum([len(d) for d in docs])
    doc, first, last, anchor, h = suffixes.pieces(data, ends)
    of = {}
    seen = []
    for d, p, q, a, x in zip(doc, first, last, anchor, h, strict=True):
        for i in range(p, q + 1):
            w = bytes(data[i : i + 50])
            assert of.setdefault(w, (a - i, x)) == (a - i, x) and 0 <= a - i <= 50 - suffixes.K
            seen.append((d, i))
    starts = ends - [len(d) for d in docs]
    assert sorted(seen) == [(k, i) for k, d in enumerate(docs) for i in range(starts[k], starts[k] + len(d) - 49)]
    whole = list(zip(doc, first, last, anchor, h, strict=True))
    suffixes_span, suffixes.SPAN = suffixes.SPAN, 97
    try:
        again = suffixes.pieces(data, ends)
    finally:
        suffixes.SPAN = suffixes_span
    split = {(d, i, a, x) for d, p, q, a, x in zip(*again, strict=True) for i in range(p, q + 1)}
    assert split == {(d, i, a, x) for d, p, q, a, x in whole for i in range(p, q + 1)}


def texts():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, common = [prose(40) for _ in range(6)], prose(30)
    out = []
    for _ in range(120):
        parts = [prose(rng.randrange(0, 40))]
        for _ in range(rng.randrange(0, 4)):
            s = rng.choice(shared)
            a = rng.randrange(len(s))
            parts += [s[a : a + rng.randrange(30, 140)], prose(rng.randrange(0, 6))]
        out.append(rng.choice(["", " "]).join([*parts, common]))
    return out + out[:20] + ["a" * 49, "a" * 50, "a" * 3000, "ab" * 900, "a" * 60 + "b" + "a" * 55, "", None]


@pytest.mark.parametrize("hot", [4096, 3])
def test_against_all_strings(spark, monkeypatch, hot):
    """Also where anchors count as frequent, blocks are small, and ids come in any order."""
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "CHUNK", 150)
    monkeypatch.setattr(suffixes, "PIECES", 60)
    rows = list(enumerate(texts()))
    random.Random(1).shuffle(rows)
    ids = random.Random(2).sample(range(-500, 500), len(rows))
    rows = [(i, t) for i, (_, t) in zip(ids, rows, strict=True)]
    rows += [rows[3], rows[4], (rows[5][0], rows[6][1]), (None, rows[7][1]), (None, rows[7][1]), (None, None)]
    assert got(spark, rows) == brute(rows)


def test_long_texts_and_none(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh ") for _ in range(600_000))
    rows = [(1, long), (2, long[1000:400_000] + "!" + long[:70]), (3, "short")]
    out = {int(r[0]): r for r in got(spark, rows)}
    assert out[1][2] == 0 and out[2][2:4] == (399_070, 2) and out[3][2] == 0
    assert got(spark, []) == []
    assert got(spark, [(1, None), (2, "x")]) == brute([(1, None), (2, "x")])


def test_groups_have_equal_shares_of_anchors():
    """Anchors are least hashes; dealt by their size, the first of 16 groups would get most of them."""
    data = np.random.default_rng(4).integers(97, 123, 400_000).astype(np.uint8)
    *_, h = suffixes.pieces(data, np.array([len(data)]))
    shares = np.bincount(suffixes._groups(np.unique(h), 16), minlength=16) / len(np.unique(h))
    assert shares.max() < 1.1 / 16 and shares.min() > 0.9 / 16


def test_single_windows_of_frequent_anchors_meet_those_of_longer_texts():
    rng = random.Random(6)
    long = bytes(rng.choice(b"abcdefgh ") for _ in range(60))
    one, two = suffixes._Held(), suffixes._Held()
    one.put(long[3:53], 9, 7, 1, [5, 0])
    two.put(long, 9, 10, 2, [6, 0])
    for held in (one, two):
        held.split({9})
    assert one.texts[long[3:53]][0] == two.texts[long[3:53]][0] and len(two.texts) == 11
