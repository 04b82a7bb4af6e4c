"""Benchmark decontamination against a plain search with templates of its own: strings in place of hashes, every window
of every document against every item."""

import random
import re
from functools import cache

import pytest

from terrace.llm import decontam

NAMES = ["Alice", "Bob", "Carla", "Deniz", "Emeka", "Fatou"]
WORDS = [a + b for a in ("ba", "le", "mo", "ru", "ti", "so", "ga") for b in ("n", "per", "lt", "ck", "ster", "nd", "ry")]


@cache
def plain_words(text):
    """Of each word: its core in lower case (or the bare sign), kind, first of a sentence, capital."""
    out, first = [], True
    for raw in (text or "").split():
        m = re.search(r"(?:[+\-−$€£](?=\d))*[^\W_](?:.*[^\W_])?(?:(?<=\d)%)?", raw)
        core = m.group() if m else ""
        kind = "word"
        if not core:
            kind = "sign"
        elif re.fullmatch(r"[+\-−]?[$€£]?\d+([.,:/]\d+)*(%|st|nd|rd|th)?", core):
            kind = "number"
        elif re.fullmatch(r"\d+(\.\d+)?[a-z]+", core) and re.sub(r"[\d.]", "", core) in decontam.UNITS:
            kind = "measure"
        elif core.lower() in decontam.UNITS:
            kind = "unit"
        out.append((core.lower() or raw, kind, first, core[:1].isupper()))
        first = bool(re.search(r"[.!?…]['\"”»)]*$", raw))
    return out


@cache
def plain_views(text):
    """{view: (windows by place, slot values by word)}; a window of too few plain words is left out."""
    words = [w for w in plain_words(text) if w[1] != "sign"]
    typed = []
    for i, (_, kind, _, _) in enumerate(words):
        after = i > 0 and words[i - 1][1] in ("number", "measure")
        typed.append("<num>" if kind == "number" else "<measure>" if kind == "measure" else "<unit>" if kind == "unit" and after else None)
    capital = [w[3] and t != "<unit>" for w, t in zip(words, typed, strict=True)]
    inside = [c and not w[2] for c, w in zip(capital, words, strict=True)]
    out, n = {}, min(5, len(words))
    for view, names in ((0, [False] * len(words)), (1, inside), (2, capital)):
        if not words or view and not any(names):
            continue
        shape = ["<name>" if m else t or w[0] for m, t, w in zip(names, typed, words, strict=True)]
        slot = [w[0] if m or t else None for m, t, w in zip(names, typed, words, strict=True)]
        windows = {k: tuple(shape[k : k + n]) for k in range(len(shape) - n + 1) if sum(s is None for s in slot[k : k + n]) >= min(3, n)}
        out[view] = windows, slot, len(shape) - n + 1
    return out


def plain_coverage(item, doc):
    """(coverage, verbatim) of an item in a document, or None below the limit."""
    a, b = plain_views(item), plain_views(doc)
    best = []
    if a and not a[0][0]:
        seek, text = [w[:2] for w in plain_words(item)], [w[0] for w in plain_words(doc)]
        while seek and seek[-1][1] == "sign":
            seek.pop()
        while seek and seek[0][1] == "sign":
            seek.pop(0)
        seek = [w for w, _ in seek]
        return (1.0, True) if any(text[k : k + len(seek)] == seek for k in range(len(text) - len(seek) + 1)) else None
    for view in a.keys() & b.keys():
        (mine, my_slots, total), (other, other_slots, _) = a[view], b[view]
        if not mine or view == 2 and 2 * len(mine) < total:
            continue
        runs = {}
        for i, w in mine.items():
            for k, x in other.items():
                if w == x:
                    at, values = runs.setdefault(k - i, (set(), set()))
                    at.add(i)
                    values |= {(my_slots[i + j], other_slots[k + j]) for j in range(len(w)) if my_slots[i + j] is not None}
        good = [(at, v) for at, v in runs.values() if len({i for i, _ in v}) == len(v)]
        share = len(set().union(*(at for at, _ in good))) / len(mine)
        if good and share >= 0.8:
            best.append((share, all(i == d for _, v in good for i, d in v)))
    return (max(c for c, _ in best), any(v for _, v in best)) if best else None


def template(rng, n):
    """A question of n words with slots {k} for numbers and [k] for names, some of them used twice."""
    out, new, who = [], 0, 0
    for i in range(n):
        r = rng.random()
        if r < 0.10:
            k = rng.randrange(new + 1)
            new = max(new, k + 1)
            out.append(f"{{{k}}}" + rng.choice(["", "", "%", "km", " miles" if i < n - 1 else ""]))
        elif r < 0.22:
            k = rng.randrange(min(who + 1, 3))
            who = max(who, k + 1)
            out.append(f"[{k}]")
        else:
            out.append(rng.choice(WORDS) + rng.choice(["", "", "", "", ",", "."]))
    return " ".join(out)


def filled(rng, text, consistent=True):
    numbers, names = rng.sample(range(2, 900), 40), rng.sample(NAMES, 3)
    number = lambda m: str(numbers[int(m[1])] if consistent else rng.randrange(2, 900))
    return re.sub(r"\[(\d)\]", lambda m: names[int(m[1])], re.sub(r"\{(\d+)\}", number, text))


@pytest.mark.parametrize("seed", [1, 2])
def test_report_equals_a_plain_search(spark, seed):
    rng = random.Random(seed)
    shapes = [template(rng, n) for n in [*range(1, 45), 12, 20, 30]]
    items = [(i, filled(rng, s)) for i, s in enumerate(shapes)] + [(900, "7 * 8 = 56"), (901, None), (902, "- ?"), (903, "What is 12 + 30 - 7 ?")]
    prose = lambda n: filled(rng, template(rng, n))
    docs, planted = [(0, None), (1, ""), (2, "- - ."), (3, "so 7 * 8 = 56, they say"), (4, "What is 12 + 30 - 7 ?"), (5, prose(3000))], {3: 900, 4: 903}
    for i, shape in enumerate(shapes):
        exact = items[i][1]
        cut = exact.split()
        for body, holds in ((exact, True), (filled(rng, shape), True), (filled(rng, shape, False), False), (" ".join(cut[: len(cut) * 7 // 8]), False), (" ".join(cut[: len(cut) // 2]), False)):
            at = len(docs)
            docs.append((at, f"{prose(15)}. {body} {prose(rng.choice([0, 2, 15]))}"))
            if holds and len(cut) >= 8:
                planted[at] = i
    docs += [docs[9], (None, items[30][1])]
    got = decontam.report(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = []
    for d, text in docs:
        found = {i: c for i, t in items if (c := plain_coverage(t, text))}
        want.append((d, bool(found), len(found), min(found, default=None), round(max((c for c, _ in found.values()), default=0.0), 6), all(v for _, v in found.values()) if found else None))
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    caught = {r.doc_id for r in got if r.contaminated}
    assert len(planted) > 70 and len(planted.keys() & caught) >= 0.9 * len(planted)
