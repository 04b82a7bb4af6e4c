"""Encoding whole texts with a public vocabulary, fast where words repeat.

A text is cut where a blank or a line feed follows a character that is not white space. No pre-token of the supported
vocabularies reaches across such a place, so the pieces encode independently: each distinct piece is encoded once by
the library and its ids are kept, as bytes, in a bounded cache of the worker process. A new piece that ends in a word
character and plain punctuation is looked up as these two. A text whose pieces do not fit these rules (runs of white
space, special tokens) goes to the library whole. The ids are the library's in every case.
"""

from __future__ import annotations

from functools import cache
from itertools import accumulate, chain

import numpy as np

#: Distinct pieces of a cache generation. When it is full it becomes the old one, from which pieces that are met again
#: move on; what the generation before held is forgotten, which changes speed only.
CACHE_PIECES = 600_000
_CUT = "\x00"
#: Signs that stand in a pre-token of their own after a Latin letter or a digit.
_TAIL = '.,!?;:*&%$#|"'


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file, on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """``encode(texts) -> list of little-endian uint32 id bytes`` for one tokenizer file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces: dict[str, bytes | bool] = {}
        self.old: dict[str, bytes | bool] = {}
        # Some vocabularies drop white space, and some the case: then more pieces are the same.
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.drops_blanks = ids(" \n") == [] and ids("ab \n cd\n") == ids("ab cd")
        self.drops_case = ids("ABCDEFGHIJKLM NOPQRSTUVWXYZ") == ids("abcdefghijklm nopqrstuvwxyz")

    def _whole(self, texts: list[str]) -> list[bytes]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ends = [4 * x for x in accumulate(map(len, ids))]
        raw = np.fromiter(chain.from_iterable(ids), "<u4", ends[-1] // 4 if ends else 0).tobytes()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _parts(self, text: str) -> list[str] | None:
        if _CUT in text or any(s in text for s in self.special):
            return None
        if self.drops_case and text.isascii():
            text = text.lower()
        if self.drops_blanks:
            return text.replace("\n", " ").split(" ")
        parts = text.replace(" ", "\x00 ").replace("\n", "\x00\n").split(_CUT)
        return parts if parts[0] else parts[1:]

    def _learn(self, fresh: set[str]) -> None:
        known, old = self.pieces, self.old
        split: list[tuple[str, str, str]] = []
        need: dict[str, None] = {}
        for p in fresh:
            if p in old:
                known[p] = old[p]
                continue
            core = p.rstrip(_TAIL)
            if core != p and core and core[-1] < "ɐ" and core[-1].isalnum():
                tail = p[len(core) :]
                split.append((p, core, tail))
                for x in (core, tail):
                    if x not in known:
                        need[x] = None
            else:
                need[p] = None
        need = {x: None for x in need if x not in known}
        for x in [x for x in need if x in old]:
            known[x] = old[x]
            del need[x]
        # A piece that ends in white space would run into the next one: no ids, the text goes whole.
        good = [x for x in need if self.drops_blanks or (x and not x[-1].isspace())]
        known.update(dict.fromkeys(need, False))
        known.update(zip(good, self._whole(good), strict=True))
        for p, core, tail in split:
            known[p] = known[core] + known[tail]

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.pieces) > CACHE_PIECES:
            self.old, self.pieces = self.pieces, {}
        known = self.pieces
        cut = [self._parts(t) for t in texts]
        # Each distinct unknown piece once; then one lookup a piece.
        fresh = set().union(*(parts for parts in cut if parts is not None)).difference(known)
        if fresh:
            self._learn(fresh)
        out: list[bytes | None] = []
        for parts in cut:
            try:
                out.append(None if parts is None else b"".join(map(known.__getitem__, parts)))
            except TypeError:  # a piece without ids
                out.append(None)
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self._whole([texts[i] for i in rest]), strict=True):
            out[i] = x
        return out


@cache
def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core already
    return Encoder(path)
