"""Toxicity: a lexicon trie met by Levenshtein automata, and scores that look at the words around a hit.

The lexicon is learnt from labelled documents: terms that many toxic and hardly any other documents use. It is held as
a trie; a word is read by the automaton of all terms at once, whose states are sets of (trie node, edits so far), built
lazily and kept, so most words fall out after a few letters. Every hit is weighed by its surroundings: inside quotation
marks or after a word of reporting it counts as a mention, near other hits as abuse. Document features go into a
logistic score whose weights come from the same bounded sample, and from copies of it: toxic texts with their terms
misspelled, and other texts in which a term is quoted. Two neighbouring letters that changed places count as one edit.
A word of texts without the label is no misspelling, however near a term it stands; a term allows no edits at all where
several such texts have words near it.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import by_row
from terrace.llm.quality import training_rows

#: Labelled documents from which lexicon and weights are learnt, at most; and characters of each.
TRAIN_DOCS, TRAIN_CHARS = 4_000, 20_000
#: A term needs places in toxic text with so many different neighbours (and this many a toxic document), this share of
#: toxic use (classes weighed alike), and so many letters.
MIN_TOXIC, MIN_PLACES, MIN_SHARE, MIN_LETTERS = 4, 0.01, 0.97, 4
#: What the weights are without data, and how strongly they are held there: misspelled hits are rare among labels.
PRIOR, RIDGE = np.array([-3.5, 3.0, 2.0, 0.5, 1.0, 1.0, 1.5]), 0.5
#: Hits of abuse never lower a score; only the bias and mentions may.
LOWEST = np.array([-np.inf, 0.0, 0.0, -np.inf, 0.0, 0.0, 0.0])
#: Texts without the label that have words near a term, from which on it allows no edits.
STRICT_TEXTS = 5
#: Words on either side of a hit within which other hits and words of reporting count, and quotation marks.
CONTEXT, QUOTE = 6, 20
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_OPEN, _CLOSE = "\"“„«‘‹", "\"”“»’›"
#: Words that introduce another's speech, in the four languages of the tables.
REPORTING = frozenset(
    "said says wrote quoted quote called calls reported dijo dice llamó escribió citó sagte sagt schrieb nannte zitierte dit écrit appelé cité déclare".split()
)


def edits_allowed(term: str) -> int:
    """The shortest terms must match as they are."""
    return 0 if len(term) < 4 else 1 if len(term) < 10 else 2


class Lexicon:
    """A trie of terms, read through Levenshtein automata of all of them at once.

    A term that ends in ``*`` is a stem: any word that begins with it, within the edits its length allows, matches.
    """

    def __init__(self, terms: list[str], strict: frozenset[str] = frozenset()) -> None:
        self.terms, self.strict = sorted(set(terms)), strict
        self.allowed = [0 if t in strict else edits_allowed(t.rstrip("*")) for t in self.terms]
        self.stems: dict[int, int] = {}
        self.children: list[dict[str, int]] = [{}]
        self.term_at: list[int] = [-1]
        self.reach: list[int] = [0]  # most edits that a term below the node allows
        for i, t in enumerate(self.terms):
            node, stem = 0, t.endswith("*")
            t, most = t.rstrip("*"), self.allowed[i]
            self.reach[0] = max(self.reach[0], most)
            for c in t:
                nxt = self.children[node].get(c)
                if nxt is None:
                    nxt = len(self.children)
                    self.children[node][c] = nxt
                    self.children.append({})
                    self.term_at.append(-1)
                    self.reach.append(0)
                node = nxt
                self.reach[node] = max(self.reach[node], most)
            if stem:
                self.stems[node] = i
            else:
                self.term_at[node] = i
        self._steps: dict[tuple[int, str], int] = {}
        self._ids: dict[frozenset, int] = {}
        self._sets: list[frozenset] = []
        self._final: list[tuple[int, int] | None] = []
        self._begun: list[tuple[int, int] | None] = []
        self.alphabet = {c for t in self.terms for c in t}
        self._turned: dict[tuple[str, bool], int] | None = None
        self.start = self._state({0: 0})

    def _state(self, reached: dict[int, int]) -> int:
        """Close the set under skipped term letters, and give it a number."""
        todo = list(reached.items())
        while todo:
            node, cost = todo.pop()
            if reached.get(node, 99) < cost:
                continue
            for child in self.children[node].values():
                if cost + 1 <= self.reach[child] and cost + 1 < reached.get(child, 99):
                    reached[child] = cost + 1
                    todo.append((child, cost + 1))
        key = frozenset(reached.items())
        got = self._ids.get(key)
        if got is None:
            got = self._ids[key] = len(self._sets)
            self._sets.append(key)
            ends = [(cost, self.term_at[n]) for n, cost in key if self.term_at[n] >= 0 and cost <= self.allowed[self.term_at[n]]]
            self._final.append(min(ends) if ends else None)
            begun = [(cost, self.stems[n]) for n, cost in key if n in self.stems and cost <= self.allowed[self.stems[n]]]
            self._begun.append(min(begun) if begun else None)
        return got

    def _step(self, state: int, c: str) -> int:
        reached: dict[int, int] = {}
        for node, cost in self._sets[state]:
            child = self.children[node].get(c)
            if child is not None and cost < reached.get(child, 99):
                reached[child] = cost
            if cost + 1 <= self.reach[node] and cost + 1 < reached.get(node, 99):  # an added letter
                reached[node] = cost + 1
            for other, child in self.children[node].items():  # a changed letter
                if other != c and cost + 1 <= self.reach[child] and cost + 1 < reached.get(child, 99):
                    reached[child] = cost + 1
        return self._state(reached) if reached else -1

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term number) of the nearest term within its allowance; None without one."""
        if len(self._steps) > 2_000_000:  # bounds memory; states are rebuilt
            self.__init__(self.terms, self.strict)
        state, best = self.start, None
        for c in word:
            key = (state, c if c in self.alphabet else "\0")
            state = self._steps.get(key, -2)
            if state == -2:
                state = self._steps[key] = self._step(*key)
            if state < 0:
                return best
            begun = self._begun[state]
            if begun:
                if not begun[0]:
                    return begun
                best = begun if best is None else min(best, begun)
        ends = self._final[state]
        return best if ends is None else ends if best is None else min(best, ends)

    def turned(self, word: str) -> tuple[int, int] | None:
        """(1, term number) of a term that the word becomes, or begins with, when two of its letters change places."""
        if self._turned is None:
            self._turned, self._ends = {}, {}
            for n, t in enumerate(self.terms):
                stem = t.rstrip("*")
                if not self.allowed[n]:
                    continue
                for i in range(len(stem) - 1):
                    if stem[i] != stem[i + 1]:
                        self._turned.setdefault((stem[:i] + stem[i + 1] + stem[i] + stem[i + 2 :], t.endswith("*")), n)
                if t.endswith("*"):
                    self._ends.setdefault((stem[:-1], stem[-1]), n)  # its last letter stands behind the next one
            self._sizes = sorted({len(w) for w, stem in self._turned if stem})
        found = self._turned.get((word, False))
        for k in self._sizes if found is None else ():
            found = self._turned.get((word[:k], True)) if len(word) >= k else None
            if found is None and len(word) > k and word[k - 1] != word[k]:
                found = self._ends.get((word[: k - 1], word[k]))
            if found is not None:
                break
        return None if found is None else (1, found)


@dataclass
class Model:
    terms: list[str]
    weights: np.ndarray
    strict: frozenset[str] = frozenset()  # terms that must match letter for letter
    exempt: frozenset[str] = frozenset()  # words that stand near a term and are none
    lexicon: Lexicon | None = field(default=None, compare=False)
    known: dict[str, tuple[int, int] | None] = field(default_factory=dict, compare=False)

    def __getstate__(self) -> dict:
        return {"terms": self.terms, "weights": self.weights, "strict": self.strict, "exempt": self.exempt, "lexicon": None, "known": {}}

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term number) of a word, if it is a term or a misspelt one."""
        if self.lexicon is None:
            self.lexicon = Lexicon(self.terms, self.strict)
        got = self.lexicon.match(word)
        if got is None:
            got = self.lexicon.turned(word)
        return None if got and got[0] and word in self.exempt else got

    def hits(self, text: str) -> list[dict]:
        """Every lexicon hit: word number, place, term, edits, and whether its window shows quotation."""
        low = text.lower()
        known = self.known
        if len(known) > 400_000:
            known.clear()
        words = _WORD.findall(low)
        found = []
        for i, w in enumerate(words):
            try:
                m = known[w]
            except KeyError:
                m = known[w] = self.match(w)
            if m is not None:
                found.append((i, m))
        if not found:
            return []
        spans = [m.span() for m in _WORD.finditer(low)]
        out = []
        for i, (edits, term) in found:
            a, b = max(0, i - QUOTE), min(len(words), i + QUOTE + 1)
            before, after = text[max(0, spans[a][0] - 2) : spans[i][0]], text[spans[i][1] : spans[b - 1][1] + 1]
            opened = max((before.rfind(c) for c in _OPEN), default=-1)
            quoted = opened >= 0 and any(c in after for c in _CLOSE) and not any(c in before[opened + 1 :] for c in _CLOSE)
            told = any(w in REPORTING for w in words[max(0, i - CONTEXT) : i])
            out.append({"word": i, "start": spans[i][0], "end": spans[i][1], "term": self.terms[term], "edits": edits, "quoted": quoted, "told": told})
        return out

    def features(self, text: str | None) -> np.ndarray:
        """Bias, then saturating counts: exact and misspelled abuse, mentions, crowded hits; hits against length."""
        hits = self.hits(text or "")
        plain = [h for h in hits if not (h["quoted"] or h["told"])]
        exact = sum(h["edits"] == 0 for h in plain)
        near = len(plain) - exact
        places = [h["word"] for h in plain]
        crowded = sum(b - a <= 2 * CONTEXT for a, b in zip(places, places[1:], strict=False))
        words = 1 + len(text or "") / 6
        return np.array([1.0, min(exact, 3), min(near, 3), min(len(hits) - len(plain), 3), min(crowded, 3), min(1.0, 20 * exact / words), float(exact > 0)])

    def score(self, text: str | None) -> float:
        z = float(self.features(text) @ self.weights)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def _stems(around: dict[str, set], seen: Counter, n1: int, n0: int) -> list[str]:
    """Beginnings of five letters or more that many different toxic words share and other text hardly uses."""
    places, words, other = Counter(), Counter(), Counter()
    for w, at in around.items():
        for k in range(5, len(w)):
            places[w[:k]] += len(at)
            words[w[:k]] += 1
    for w, k in seen.items():
        for i in range(5, len(w) + 1):
            other[w[:i]] += k
    good = []
    for s, k in sorted(places.items(), key=lambda x: len(x[0])):
        toxic, rest = k / max(1, n1), other[s] / max(1, n0)
        if k >= max(3 * MIN_TOXIC, 3 * MIN_PLACES * n1) and words[s] >= 5 and toxic / (toxic + rest) >= MIN_SHARE and not any(s.startswith(g) for g in good):
            good.append(s)
    return [g + "*" for g in good]


def misspell(word: str, rng: random.Random) -> str:
    """One edit away: a letter dropped, doubled or exchanged for its neighbour."""
    i = rng.randrange(1, len(word) - 1)
    return rng.choice((word[:i] + word[i + 1 :], word[:i] + word[i] + word[i:], word[:i] + word[i + 1] + word[i] + word[i + 2 :]))


def _copies(rows: list[tuple[str, int]], model: Model) -> list[tuple[str, int]]:
    """Toxic texts with their exact terms misspelled, where those allow it; and as many others with a quoted term."""
    rng = random.Random(len(rows))
    out = []
    for t, _ in [r for r in rows if r[1]]:
        hits = [h for h in model.hits(t) if h["edits"] == 0 and h["term"] not in model.strict and edits_allowed(h["term"].rstrip("*"))]
        for h in reversed(hits):
            t = t[: h["start"]] + misspell(t[h["start"] : h["end"]], rng) + t[h["end"] :]
        if hits:
            out.append((t, 1))
    whole = [t for t in model.terms if not t.endswith("*")] or [t.rstrip("*") for t in model.terms]
    clean = [t for t, y in rows if not y]
    for t in clean[: sum(y for _, y in rows)]:
        at = t.find(" ", len(t) // 2)
        quote = f' {rng.choice(sorted(REPORTING))}: "{rng.choice(whole)}" '
        out.append((t + quote if at < 0 else t[:at] + quote + t[at:], 0))
    return out


def learn(rows: list[tuple[str | None, int]]) -> Model:
    """Lexicon and weights from (text, label) examples. Without toxic examples every score is low."""
    rows = [(t or "", y) for t, y in rows]
    n1 = sum(y for _, y in rows)
    n0 = len(rows) - n1
    seen: Counter = Counter()
    around: dict[str, set] = {}
    for t, y in rows:
        words = _WORD.findall(t.lower())
        if y:
            for before, w, after in zip(["", *words], words, [*words[1:], ""], strict=False):
                around.setdefault(w, set()).add((before, after))
        else:
            seen.update(set(words))
    # Copies of one document repeat its words between the same neighbours: places count, not documents.
    least = max(MIN_TOXIC, MIN_PLACES * n1)
    terms = []
    for w, places in around.items():
        toxic, other = len(places) / max(1, n1), seen[w] / max(1, n0)
        if len(places) >= least and len(w) >= MIN_LETTERS and toxic / (toxic + other) >= MIN_SHARE:
            terms.append(w)
    terms = sorted(terms + _stems(around, seen, n1, n0))
    if not n1 or not terms:
        return Model(terms, PRIOR.copy())
    model = Model(terms, PRIOR.copy())
    near = {w: terms[m[1]] for w in seen if (m := model.match(w)) and m[0]}
    texts: Counter = Counter()
    for w, term in near.items():
        texts[term] += seen[w]
    model = Model(terms, PRIOR.copy(), frozenset(t for t, k in texts.items() if k >= STRICT_TEXTS), frozenset(near))
    rows += _copies(rows, model)
    n1 = sum(y for _, y in rows)
    n0 = len(rows) - n1
    x = np.stack([model.features(t) for t, _ in rows])
    y = np.array([y for _, y in rows], float)
    case = np.where(y == 1, len(y) / (2 * n1), len(y) / (2 * max(1, n0)))
    w = PRIOR.copy()

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float((case * (np.logaddexp(0, z) - y * z)).sum() + RIDGE / 2 * ((v - PRIOR) ** 2).sum())

    for _ in range(60):  # Newton steps, halved until the loss falls
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        g = x.T @ (case * (p - y)) + RIDGE * (w - PRIOR)
        h = (x * (case * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w))
        free = (w > LOWEST) | (g < 0)  # weights at their bound stay there unless the loss falls inside
        step, now = np.zeros_like(w), loss(w)
        step[free] = np.linalg.solve(h[np.ix_(free, free)], g[free])
        while loss(np.maximum(w - step, LOWEST)) > now and np.abs(step).max() > 1e-9:
            step /= 2
        before, w = w, np.maximum(w - step, LOWEST)
        if np.abs(w - before).max() < 1e-7:
            break
    model.weights = w
    return model


def fit_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model:
    return learn(training_rows(docs, labels, "toxic", 3, 1, TRAIN_DOCS, TRAIN_CHARS, doc_id, text))


def score_toxicity(docs: DataFrame, model: Model, cut: float = 0.7, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Score every whole text. Null and empty texts get the score of no hits; repeated rows are scored alike; extra
    columns are not read."""
    from terrace.llm.common import crc_bucket

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(ids: list, texts: list) -> list[tuple]:
        m = shared.value
        out = []
        for i, t in zip(ids, texts, strict=True):
            s = m.score(t)
            out.append((i, s, int(s >= cut)))
        return out

    scored = by_row(docs, [doc_id, text], "doc_id bigint, score double, predicted int", rows)
    return scored.select("doc_id", F.coalesce(crc_bucket("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")
