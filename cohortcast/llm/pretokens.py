"""Splitting texts into pre-tokens with numpy, for the two public BPE vocabularies.

Characters fall into four classes (white space, letter, number, other). Pre-tokens are runs of one
class, with the exceptions that the vocabularies' patterns make: contractions such as 's, a space
that joins the next run (`spaced`), or single digits and dropped white space (otherwise).
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np

from .text import U64, mix, span_hashes

SPACE, LETTER, NUMBER, OTHER = range(4)
#: The characters with Unicode's White_Space property.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    out[WHITE] = SPACE
    return out


@lru_cache(1)
def char_table() -> np.ndarray:
    return mix(np.arange(1, sys.maxunicode + 2, dtype=U64))


class PreTokens:
    """Pre-tokens of many texts: spans of code points [start, end), text number and hash of each."""

    def __init__(self, texts: list[str], spaced: bool):
        cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        bound = np.concatenate(([0], np.cumsum(size)))
        n = len(cp)
        self.cp, self.n_texts = cp, len(texts)
        if not n:
            self.start = self.end = self.doc = np.empty(0, np.int64)
            self.hash = np.empty(0, U64)
            self.first = np.zeros(len(texts) + 1, np.int64)
            return
        cls = classes()[cp]
        head = np.zeros(n + 1, bool)  # where a text begins
        head[bound] = True
        cut = np.empty(n + 1, bool)  # where a pre-token begins
        cut[0] = cut[n] = True
        np.not_equal(cls[1:], cls[:-1], out=cut[1:n])
        cut |= head
        runs = np.flatnonzero(cut)
        lo, hi = runs[:-1], runs[1:]
        kind = cls[lo]
        joined = np.zeros(n + 1, bool)  # runs that a space before them joins
        if spaced:
            inner = (kind == SPACE) & ~head[hi]
            last = hi[inner] - 1
            cut[last] = True
            to = last[cp[last] == 0x20] + 1
            cut[to] = False
            joined[to] = True
        else:
            cut[:n] |= cls == NUMBER
        quote = lo[(kind == OTHER) & (hi - lo == 1) & (cp[lo] == 0x27) & ~joined[lo] & ~head[hi]]
        if len(quote):
            a = cp[quote + 1]
            b = np.where(head[np.minimum(quote + 2, n)], 0, cp[np.minimum(quote + 2, n - 1)])
            one = np.isin(a, [ord(c) for c in "stmd"])
            two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
            cut[quote[one | two] + 1] = False
            cut[quote[one] + 2] = True
            cut[quote[two] + 3] = True
        edge = np.flatnonzero(cut)
        self.start, self.end = edge[:-1], edge[1:]
        if not spaced:
            keep = cls[self.start] != SPACE
            self.start, self.end = self.start[keep], self.end[keep]
        self.first = np.searchsorted(self.start, bound)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.hash = span_hashes(cp, self.start, self.end, char_table())

    def text(self, k: int) -> str:
        return self.cp[self.start[k] : self.end[k]].tobytes().decode("utf-32-le", "surrogatepass")


def split_special(texts: list[str | None], specials: list[str]):
    """Cuts texts at special strings: pieces, the text number of each piece, and (piece number, special's
    number) for those that are special strings themselves. Null is an empty text."""
    import re

    cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True)) + ")") if specials else None
    number = {s: k for k, s in enumerate(specials)}
    pieces, owner, special = [], [], []
    for k, t in enumerate(texts):
        t = t or ""
        parts = cut.split(t) if cut and any(s in t for s in specials) else [t]
        for j, part in enumerate(parts):
            if j % 2:
                special.append((len(pieces), number[part]))
                part = ""
            pieces.append(part)
            owner.append(k)
    return pieces, np.array(owner, np.int64), special
