"""Operators that treat rows alone: sharding, rules, pseudonyms, templates, classifiers."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.llm import decontam, pii, quality, rules, sharding, toxicity

ROWS = [(1, "Some text é.", "en", "a"), (2, None, None, None), (3, "", "de", "b"), (3, "", "de", "b"), (None, "null id", "en", "a"), (4, "x" * 200_000, "en", "hot")]
ROWS += [(10 + i, f"document number {i} " * (i % 37), ("en", "de", "fr")[i % 3], "hot" if i % 3 else f"s{i % 7}") for i in range(600)]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as cell", "2 as n", "'z' as shard", "3 as part")


@pytest.mark.parametrize("rank_rows", [7, 2000])
def test_shards_are_even_and_gapless(spark, rank_rows):
    got = sharding.shard(frame(spark), 24, rank_rows=rank_rows).collect()
    assert len(got) == len(ROWS)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append((r.slot, r.curve_index))
    assert set(slots) == set(range(24))
    sizes = [len(v) for v in slots.values()]
    assert max(sizes) - min(sizes) <= 1
    path = []
    for s in range(24):
        assert sorted(x for x, _ in slots[s]) == list(range(len(slots[s])))
        path += [c for _, c in sorted(slots[s])]
    assert path == sorted(path)  # shards are runs of the curve
    want = sorted((str(d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _, _ in ROWS)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == want


def test_fewer_rows_than_shards_and_none(spark):
    got = sharding.shard(frame(spark, ROWS[:5]), 24).collect()
    assert len({r.shard for r in got}) == 5 and {r.slot for r in got} == {0}
    assert sharding.shard(frame(spark, []), 24).count() == 0


def test_hilbert_in_columns(spark):
    cells = spark.range(512).select(sharding.hilbert_index([F.floor(F.col("id") / 64), F.floor(F.col("id") / 8) % 8, F.col("id") % 8], 3).alias("h"), "id").orderBy("h").collect()
    assert [r.h for r in cells] == list(range(512))
    at = [(r.id // 64, r.id // 8 % 8, r.id % 8) for r in cells]
    assert all(sum(abs(x - y) for x, y in zip(a, b, strict=True)) == 1 for a, b in zip(at, at[1:], strict=False))


def slow_rules(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    again = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(again)


def test_rules_against_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t", "a", "a b\n\na b\n c", "é x y\x0bz", "# * $ % & | < >"]
    for _ in range(60):
        w = [rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(0, 120))]
        if rng.random() < 0.6 and len(w) > 20:
            w = w + w[5 : 5 + rng.randrange(3, 14)] + w[:9]
        texts.append("".join(x + rng.choice(["\n", " ", "  "]) for x in w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("kept", F.lit("clash"))
    for r in rules.quality_rules(df).collect():
        n, chars, signs, dup, again = slow_rules(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, signs, dup, again)
        assert r.base_failed == (n < 20 or 100 * again > 30 * n)
        assert not (r.kept and r.base_failed)
    assert rules.quality_rules(df.limit(0)).count() == 0


def test_rules_reject_a_text_of_repeats_and_keep_prose():
    prose = " ".join(f"w{i}" for i in range(400))
    assert rules.verdict(rules.repetition(prose))
    assert not rules.verdict(rules.repetition("\n".join(["the same long line of text again and again"] * 30)))
    long = " ".join(f"w{i}" for i in range(200_000))
    assert rules.repetition(long)["n_words"] == 200_000


def slow_permute(symbols, sizes, key, kind, rounds=pii.ROUNDS):
    """The network again, with hashlib in place of Spark's function."""
    sha = lambda *parts: hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()
    secret = hashlib.sha256(key.encode()).hexdigest()
    n, v = len(symbols), list(symbols)
    half = n // 2
    for r in range(rounds):
        left = r % 2 == 0
        other = v[half:] if left else v[:half]
        seed = sha(secret, sha(secret, kind, n, r, ",".join(map(str, other))))
        for i in range(n):
            if (i < half) == left:
                v[i] = (v[i] + int(sha(seed, i)[:15], 16) % sizes[i]) % sizes[i]
    return v


def test_permutation_is_a_bijection_and_as_described(spark):
    df = spark.range(1000).select("id", F.lpad(F.col("id").cast("string"), 3, "0").alias("t"))
    got = {r.t: r.p for r in df.select("t", pii.permute_text(F.col("t"), "k", "card", False).alias("p")).collect()}
    assert sorted(got.values()) == sorted(got)
    assert sum(a == b for a, b in got.items()) < 20
    for t in ("000", "123", "999"):
        assert got[t] == "".join(map(str, slow_permute([int(c) for c in t], [10] * 3, "k", "card")))


def luhn(s):
    return sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(s))) % 10 == 0


PRIVATE = {
    "card": "4845168114407329",
    "ip": "161.17.88.162",
    "phone": "+1 (974) 555-3436",
    "email": "and.34@mail7.example.com",
    "date": "2020-02-29",
    "secret": "04dbebab91ab85687d33eeaaf9ac699e1188f962",
    "iban": "GB82WEST12345698765432",
    "ssn": "123-45-6789",
}


def test_values_keep_their_format_and_stay_linked(spark):
    texts = [f"A {v}, then {v}. End" for v in PRIVATE.values()] + ["31/12/1999 or 99/99/1999", "1234567812345678", "300.1.1.1 1.2.3.4.5", None, "", "plain words only", " ".join(PRIVATE.values())]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("pii_kinds", F.lit("clash")).withColumn("k", F.lit(1))
    got = {r.doc_id: r for r in pii.pseudonymise(df, "key").collect()}
    assert len(got) == len(texts)
    for i, (kind, v) in enumerate(PRIVATE.items()):
        out = got[i].text
        m = re.fullmatch(r"A (.*), then (.*)\. End", out)
        assert got[i].pii_kinds == [kind, kind] and m[1] == m[2] != v and v not in out
        assert re.sub(r"[0-9]", "9", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", m[1]))) == re.sub(r"[0-9]", "9", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", v))) or kind in ("ip", "secret")
        assert m[1] in got[len(texts) - 1].text  # the same pseudonym in another document
    card, ip, iban = (re.match(r"A (.*), then", got[i].text)[1] for i in (0, 1, 6))
    assert luhn(card) and all(int(x) < 256 for x in ip.split(".")) and re.fullmatch("[0-9a-f]{40}", re.match(r"A (\S*), then", got[5].text)[1])
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    n = len(PRIVATE)
    assert got[n].pii_kinds == ["date"] and got[n].text.endswith("99/99/1999")
    assert got[n + 1].text == texts[n + 1] and got[n + 2].text == texts[n + 2]  # fail validation
    assert got[n + 3].text is None and got[n + 3].pii_kinds == [] and got[n + 4].text == "" and got[n + 5].text == texts[n + 5]
    other = pii.pseudonymise(df.limit(1), "another key").first().text
    assert other != got[0].text
    assert pii.pseudonymise(df.limit(0), "key").count() == 0


def test_pseudonyms_in_odd_tables(spark):
    """A very long text, repeated rows, no id, and columns named like helpers."""
    card, filler = PRIVATE["card"], "many plain words without any value. "
    long = f"{filler * 40_000}{card} {filler * 10}"
    rows = [(1, long), (2, f"pay {card} now"), (2, f"pay {card} now"), (None, f"pay {card} now")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("pii", "_pii", "k", "v")})
    out = pii.pseudonymise(df, "key")
    assert out.columns == [*df.columns, "pii_kinds"]
    got = out.collect()
    assert all((r.pii, r._pii, r.k, r.v, r.pii_kinds) == ("x", "x", "x", "x", ["card"]) for r in got)
    (short,) = {r.text for r in got if r.doc_id != 1}
    moved = short.split()[1]
    assert moved != card and next(r.text for r in got if r.doc_id == 1) == long.replace(card, moved)


def test_dates_map_one_to_one(spark):
    days = spark.range(3000).select(F.date_format(F.date_add(F.lit("1999-06-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    out = [r.text for r in pii.pseudonymise(days, "key").collect()]
    assert len(set(out)) == 3000 and all(re.fullmatch(r"(19|20)\d\d-\d\d-\d\d", x) for x in out)


ITEMS = [(1, "A train leaves Boston at 9 and travels 120 miles in 3 hours so what is its average speed over the whole trip"), (2, "Short one"), (3, None), (4, "zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn")]
FILL = " ".join(f"filler{i}" for i in range(60))


def test_leaks_are_found_under_new_parameters(spark):
    a = ITEMS[0][1]
    docs = {
        1: f"{FILL} {a} {FILL}",
        2: f"{FILL}\n{a.upper()}.",
        3: f"{FILL} {a.replace('Boston', 'Denver').replace('120', '95').replace('9 ', '7 ')} {FILL}",
        4: FILL,
        5: f"{FILL} {' '.join(a.split()[:9])} {FILL}",
        6: None,
        7: "",
        8: f"{FILL} {ITEMS[3][1]}",
        9: "it was a short one here",
    }
    rows = [*docs.items(), (1, docs[1]), (None, docs[8])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("hash", F.lit(0))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: r for r in decontam.report(df, bench).collect()}
    assert {d for d, r in got.items() if r.contaminated} == {1, 2, 3, 8, None}
    assert got[1].verbatim and got[1].item_id == 1 and not got[3].verbatim and got[8].item_id == 4
    assert decontam.report(df, bench).count() == len(rows)
    assert {r.doc_id for r in decontam.without_leaks(df, bench).collect()} == {4, 5, 6, 7, 9}
    assert decontam.report(df.limit(0), bench).count() == 0
    # Rows that share an id, or have none, with and without an item; and columns named like helpers.
    item = bench.first().text
    shared = spark.createDataFrame([(1, item), (1, "a clean text"), (None, "another clean text"), (None, f"so: {item}"), (2, "clean"), (2, None)], "doc_id long, text string")
    shared = shared.withColumns({x: F.lit("x") for x in ("_leak", "of", "_of", "row", "hash", "view")})
    left = decontam.without_leaks(shared, bench)
    assert left.columns == shared.columns and sorted(str(r.text) for r in left.collect()) == ["None", "a clean text", "another clean text", "clean"]
    assert sorted(r.contaminated for r in decontam.report(shared, bench).collect()) == [False] * 4 + [True] * 2
    assert not any(r.contaminated for r in decontam.report(df, bench.limit(0)).collect())


def test_inconsistent_slots_are_no_copy(spark):
    item = [(1, "take 5 apples and give 5 pears then count 5 plums and carry 5 nuts back to the old house again")]
    words = item[0][1].split()
    fives = [i for i, w in enumerate(words) if w == "5"]
    even, odd = words.copy(), words.copy()
    for k, i in enumerate(fives):
        even[i], odd[i] = "8", str(10 + k)
    docs = spark.createDataFrame([(1, " ".join(even)), (2, " ".join(odd))], "doc_id long, text string")
    got = {r.doc_id: r.contaminated for r in decontam.report(docs, spark.createDataFrame(item, "item_id long, text string")).collect()}
    assert got == {1: True, 2: False}


def slow_match(lexicon, word):
    def edits(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            e = [i]
            for j, y in enumerate(b, 1):
                e.append(min(d[j] + 1, e[-1] + 1, d[j - 1] + (x != y)))
            d = e
        return d[-1]

    best = [(edits(word, t), i) for i, t in enumerate(lexicon.terms)]
    best = [(k, i) for k, i in best if k <= toxicity.edits_allowed(lexicon.terms[i])]
    return min(best) if best else None


def test_automaton_equals_brute_force():
    lexicon = toxicity.Lexicon(["moron", "worthless", "disgusting", "pathetic", "scumbag", "scumbags", "abcdef"])
    rng = random.Random(6)
    words = ["", "moron", "oron", "worthles", "wrthless", "disgustin", "xdisgustingx", "scumbags", "scumbagz", "abdcef"]
    for t in lexicon.terms * 40:
        w = list(t)
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(w) + 1)
            w[i : i + rng.randrange(2)] = rng.choice([[], ["q"], ["e"]])
        words.append("".join(w))
    for w in words:
        assert lexicon.match(w) == slow_match(lexicon, w), w
    assert toxicity.Lexicon(["vequ*"]).match("vequille") == (0, 0)
    assert toxicity.Lexicon([]).match("word") is None


def labelled(rng, n=400):
    rows = []
    for _ in range(n):
        w = [rng.choice("abcdefghij") * rng.randrange(2, 5) for _ in range(40)]
        y = rng.random() < 0.3
        if y:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["worthless", "pathetic", "moron"]))
        rows.append((" ".join(w), int(y)))
    return rows


def test_toxicity_learns_terms_and_reads_context():
    rng = random.Random(7)
    m = toxicity.learn(labelled(rng))
    assert {"worthless", "pathetic", "moron"} <= set(m.terms)
    held = labelled(rng)
    assert np.mean([(m.score(t) >= 0.7) == bool(y) for t, y in held]) > 0.97
    abuse, quote = "you are a worthless moron and pathetic", 'he said "you are a worthless moron and pathetic" and left'
    assert m.score(abuse) > 0.7 > m.score(quote)
    assert m.score("you worthles patheticc thing") > m.score("you good thing")
    assert m.score(None) == m.score("") < 0.7 and toxicity.learn([]).score("x") < 0.7


def test_misspellings_and_quotations_decide(monkeypatch):
    """Held-out toxic texts with every term misspelled are found, those with every term quoted are not; without the
    automaton's edits, or without the windows, neither holds."""
    rng = random.Random(17)
    m = toxicity.learn(labelled(rng))
    terms = ["worthless", "pathetic"]
    toxic = [" ".join(rng.choice(terms) if w in (*terms, "moron") else w for w in t.split()) for t, y in labelled(rng) if y]
    wrong = [" ".join(toxicity.misspell(w, rng) if w in terms else w for w in t.split()) for t in toxic]
    quoted = [" ".join(f'he said "{w}"' if w in terms else w for w in t.split()) for t in toxic]
    found = lambda model, ts: np.mean([model.score(t) >= 0.7 for t in ts])
    assert found(m, toxic) > 0.95 and found(m, wrong) > 0.9 and found(m, quoted) < 0.1
    assert m.weights[2] > 0 and found(toxicity.Model(m.terms, m.weights, frozenset(m.terms)), wrong) < 0.1
    monkeypatch.setattr(toxicity, "REPORTING", frozenset())
    monkeypatch.setattr(toxicity, "_OPEN", "")
    assert found(m, quoted) > 0.9


def test_terms_near_common_words_allow_no_edits():
    rows = [("you utter throngist " * 3 + str(i), 0) for i in range(60)] + [(f"a{i} throngish b{i} throngish c{i}", 1) for i in range(20)]
    m = toxicity.learn(rows)
    assert "throngish" in m.terms and "throngish" in m.strict
    assert not m.hits("throngist thronish") and m.hits("throngish")


def test_score_equals_plain_arithmetic():
    rng = random.Random(18)
    m = toxicity.learn(labelled(rng))
    for t, _ in labelled(rng, 60):
        words = t.split()
        at = [i for i, w in enumerate(words) if w in m.terms or any(w.startswith(x[:-1]) for x in m.terms if x.endswith("*"))]
        crowded = sum(b - a <= 2 * toxicity.CONTEXT for a, b in zip(at, at[1:]))
        x = [1, min(len(at), 3), 0, 0, min(crowded, 3), min(1, 20 * len(at) / (1 + len(t) / 6)), len(at) > 0]
        assert abs(m.score(t) - 1 / (1 + np.exp(-sum(a * b for a, b in zip(x, m.weights))))) < 1e-9


def test_toxicity_query_shape(spark):
    m = toxicity.learn(labelled(random.Random(8)))
    df = spark.createDataFrame([(1, "worthless moron"), (2, None), (None, ""), (1, "worthless moron")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = toxicity.score_toxicity(df, m).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert {r.doc_id: r.held_out for r in got} == {d: d is not None and zlib.crc32(str(d).encode()) % 3 == 1 for d in (1, 2, None)}


def texts(rng, n):
    out = []
    for _ in range(n):
        w = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(5, 150))]
        y = rng.random() < 0.6
        if not y:
            w = [x + rng.choice(["***", "$$$", "&&&"]) for x in w] if rng.random() < 0.5 else [x for x in w for _ in range(4)]
        out.append((" ".join(w), int(y)))
    return out


def test_network_learns_and_sees_the_end_of_a_text():
    rng = random.Random(9)
    net = quality.train(texts(rng, 300))
    held = texts(rng, 200)
    assert np.mean([(net.score(t) >= 0.5) == bool(y) for t, y in held]) > 0.95
    clean = " ".join("".join(rng.choice("etaoinshr") for _ in range(5)) for _ in range(60_000))
    assert net.score(clean) > net.score(clean + " " + "junk*** more$$$ " * 4000)
    for t in (None, "", "a", "é" * 9):
        assert 0 <= net.score(t) <= 1
    assert quality.train([]).score("x") == 0.5


def test_blocks_do_not_change_the_score(monkeypatch):
    net = quality.train(texts(random.Random(10), 40))
    t = "some words go on and on " * 500
    whole = net.score(t)
    monkeypatch.setattr(quality, "BLOCK", 256)
    assert net.score(t) == pytest.approx(whole, abs=1e-6)


def test_repeated_words_are_marked():
    s = quality.symbols(b"ab ab cd cd cd x x")
    assert [int(v >= 256) for v in s[:18]] == [0, 0, 0, 1, 1, 0, 0, 0, 0, 1, 1, 0, 1, 1, 0, 0, 0, 0]
    assert len(quality.symbols(b"")) == quality.WIDTH


def test_training_rows_stay_outside_the_held_out_part(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    rows = quality.training_rows(docs, labels, "quality", 5, 0, 60, 900)
    assert len(rows) == 60 and sum(y for _, y in rows) == 30
    assert all(zlib.crc32(t[1:].encode()) % 5 for t, _ in rows)
    assert quality.training_rows(docs, labels.limit(0), "quality", 5, 0, 60, 900) == []


def slow_score(net, text):
    """The network's forward pass with plain loops; a byte is marked where its word of two bytes or more equals the one
    right before it."""
    data = (text or "").encode()
    words, marks = [b""], []
    for c in data:
        if c <= 32:
            words.append(b"")
        else:
            words[-1] += bytes([c])
    for k, w in enumerate(words):
        again = k > 0 and len(w) > 1 and w == words[k - 1]
        marks += ([False] if k else []) + [again] * len(w)
    codes = [c + 256 * m for c, m in zip(data, marks, strict=True)]
    while len(codes) < quality.WIDTH or (len(codes) - quality.WIDTH) % quality.STEP:
        codes.append(32)
    responses = []
    for at in range(0, len(codes) - quality.WIDTH + 1, quality.STEP):
        x = [float(v) for c in codes[at : at + quality.WIDTH] for v in net.embed[c]]
        responses.append([sum(a * float(f) for a, f in zip(x, net.filters[:, k], strict=True)) + float(net.bias[k]) for k in range(quality.FILTERS)])
    pools = [responses[k : k + quality.POOL] for k in range(0, len(responses), quality.POOL)]
    top = [[max(0.0, max(r[k] for r in p)) for k in range(quality.FILTERS)] for p in pools]
    features = [max(p[k] for p in top) for k in range(quality.FILTERS)] + [sum(p[k] for p in top) / len(top) for k in range(quality.FILTERS)]
    z = sum(a * float(d) for a, d in zip(features, net.dense, strict=True)) + float(net.offset[0])
    return 1 / (1 + math.exp(-z))


def test_score_equals_a_plain_forward_pass():
    rng = np.random.default_rng(8)
    net = quality.train([("good words in a row " * 9, 1), ("bad bad bad *** " * 9, 0)] * 8)
    net.bias[:] = rng.normal(0, 0.3, len(net.bias))
    texts = [None, "", "a", "one two", "12345678", "123456789", "the the cat cat é é sat", "a a bb bb bb\nbb", " ".join(f"w{i % 7} w{i % 5}" for i in range(400))]
    for t in texts:
        assert net.score(t) == pytest.approx(slow_score(net, t), abs=1e-4), t


def test_classifiers_on_odd_tables(spark):
    """No rows, no id, repeated rows, no text, a very long text, and columns named like results."""
    net = quality.train([("good words in a row " * 9, 1), ("bad bad bad *** " * 9, 0)] * 8)
    long = "good words in a row " * 50_000
    rows = [(1, "good words"), (1, "good words"), (None, "good words"), (2, None), (3, ""), (4, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("score", "predicted", "held_out", "y")})
    got = quality.score_quality(df, net).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    assert len({r.score for r in got if r.doc_id in (1, None)}) == 1 and len({r.score for r in got if r.doc_id in (2, 3)}) == 1
    assert next(r.score for r in got if r.doc_id == 4) == pytest.approx(net.score(long))
    assert quality.score_quality(df.limit(0), net).count() == 0
    kept = quality.keep_good(df, net, cut=0.0)
    assert kept.columns == df.columns and kept.count() == len(rows) and quality.keep_good(df.limit(0), net).count() == 0
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    empty = quality.fit_quality(df, nothing)
    assert {r.predicted for r in quality.score_quality(df, empty).collect()} == {1}  # no labels: one half for all
