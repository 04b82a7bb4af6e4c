"""Misspelled terms in real held-out texts, and words that only look like them."""

import os
import random
import zlib

import numpy as np
import pytest

from terrace.llm import toxicity

SF = "/root/testdata/sf0.01"


def test_turned_letters_and_short_terms():
    m = toxicity.Model(["moron", "idiot", "scum"], toxicity.PRIOR.copy(), frozenset(["idiot"]), frozenset(["motor"]))
    assert [m.match(w) for w in ("moron", "mroon", "moorn", "mor", "motor", "scmu", "scu")] == [(0, 1), (1, 1), (1, 1), None, None, (1, 2), (1, 2)]
    assert m.match("idiot") == (0, 0) and m.match("idoit") is None and m.match("idiott") is None


def test_words_near_a_term_pass_or_close_it():
    """A word that a few clean texts have near a term is left alone; if many have one, the term allows no edits."""
    few = [("the crown and more words", 0)] * 2 + [("nothing here", 0)] * 60 + [(f"a{i} clown b{i} clown c{i}", 1) for i in range(20)]
    m = toxicity.learn(few)
    assert m.match("clown") and m.match("cloown") and m.match("crown") is None and "clown" not in m.strict
    many = [("the crown and more words", 0)] * 30 + few
    assert "clown" in toxicity.learn(many).strict and toxicity.learn(many).match("cloown") is None


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
def test_held_out_texts_with_every_term_misspelled(spark):
    """Nearly all that are found as they are stay found with every term misspelled; without edits hardly any."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    m = toxicity.fit_toxicity(docs, labels)
    held = [(r["text"] or "", r["toxic"]) for r in docs.join(labels, "doc_id").select("doc_id", "text", "toxic").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    exact, rng = toxicity.Model(m.terms, m.weights, frozenset(m.terms), m.exempt), random.Random(3)

    def wrong(text):
        for w in reversed(list(toxicity._WORD.finditer(text.lower()))):
            if len(w.group()) >= 4 and exact.match(w.group()):
                text = text[: w.start()] + toxicity.misspell(text[w.start() : w.end()], rng) + text[w.end() :]
        return text

    toxic = [t for t, y in held if y == 1]
    bad = [wrong(t) for t in toxic]
    found = lambda model, ts: np.mean([model.score(t) >= 0.7 for t in ts])
    assert found(m, bad) >= found(m, toxic) - 0.1 and found(exact, bad) < 0.5
    assert found(m, [t for t, y in held if y == 0]) <= 0.02
