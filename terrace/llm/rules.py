"""Quality rules: how much of a text lies inside repeated n-grams and repeated lines.

Words are split once; a rolling polynomial hash modulo 2**64 gives the n-grams of every length in numpy. An n-gram of
n + 1 words can only repeat where its first n words do, so most texts are settled by the shortest length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = " \t\n\r\x0b\x0c"
_SYMBOLS = "#*$%&|<>"

#: Largest share of a text's characters in repeated n-grams of 5 to 10 words, and in repeated lines.
LIMITS = {5: 0.42, 6: 0.41, 7: 0.40, 8: 0.39, 9: 0.38, 10: 0.37}
LINE_LIMIT = 0.30


def _covered(h: np.ndarray, n: int, words: int) -> np.ndarray | None:
    """Mask of the words inside windows whose hash occurs twice or more; None without such windows."""
    s = np.sort(h)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return None
    at = np.flatnonzero(np.isin(h, twice))
    edge = np.zeros(words + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def repetition(text: str | None, lengths: tuple[int, ...] = (5, 6, 7, 8, 9, 10)) -> dict:
    """Counts of one text and, per n-gram length, the characters inside repeated n-grams.

    Null and empty texts give zeros. Words are runs without ASCII white space; an n-gram repeats when it starts at two
    or more places (they may overlap). A line repeats when an equal line with a word stands before it.
    """
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    out = {
        "n_words": n,
        "word_chars": len(text) - sum(map(text.count, _SPACE)),
        "n_symbols": sum(map(text.count, _SYMBOLS)),
        "n_dup_lines": 0,
        "line_chars": 0,
        "repeat_words": dict.fromkeys(lengths, 0),
        "repeat_chars": dict.fromkeys(lengths, 0),
    }
    if len(lines) > 1:
        seen: set[str] = set()
        for x in lines:
            if x in seen:
                out["n_dup_lines"] += 1
                out["line_chars"] += len(x)
            else:
                seen.add(x)
    first = min(lengths)
    if n <= first:
        return out
    w = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    size = None
    h = w.copy()
    for k in range(2, max(lengths) + 1):
        if n < k:
            break
        h = h[:-1] * _BASE + w[k - 1 :]
        if k not in out["repeat_words"]:
            continue
        mask = _covered(h, k, n)
        if mask is None:
            break
        if size is None:
            size = np.fromiter((len(x.decode("utf-8", "surrogatepass")) for x in words), np.int64, n)
        out["repeat_words"][k] = int(mask.sum())
        out["repeat_chars"][k] = int(size[mask].sum())
    return out


def verdict(r: dict) -> bool:
    """Keep a text unless too many of its characters lie in repeated n-grams or lines."""
    chars = max(1, r["word_chars"])
    return r["line_chars"] <= LINE_LIMIT * chars and all(v <= LIMITS[k] * chars for k, v in r["repeat_chars"].items())


SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, line_chars bigint, repeat_chars bigint"
)


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with its repetition counts, the base rule and the verdict.

    A null or empty text has no words and fails the base rule. Extra columns are not read. Equal rows give equal rows.
    """
    from terrace.llm.common import by_row

    def rows(ids: list, texts: list) -> list[tuple]:
        out = []
        for i, t in zip(ids, texts, strict=True):
            r = repetition(t)
            n, again = r["n_words"], r["repeat_words"][8]
            failed = n < 20 or 100 * again > 30 * n
            out.append((i, n, r["word_chars"], r["n_symbols"], r["n_dup_lines"], again, failed, not failed and verdict(r), r["line_chars"], max(r["repeat_chars"].values())))
        return out

    return by_row(docs, [doc_id, text], SCHEMA, rows)
