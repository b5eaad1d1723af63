"""Byte-pair merges shared by the prefix counter and the transducer.

An encoding is the one token sequence whose every token encodes to itself and whose every
neighbouring pair encodes to itself.  So the last token of each prefix follows from the last token of a
shorter prefix and a test of one pair, which is all that both users need.
"""
from __future__ import annotations

import gc
import re

import regex

NEVER = float("inf")

#: Letters, digits and blanks on which Python's two pattern libraries and Unicode's classes agree.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
ODD = re.compile(f"[^\\t-\\r -~{LETTERS}]")
#: Unicode white space, which \\s means in the tokenizers' own pattern language.
BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def splitter(pattern: str):
    """findall of a tokenizer's pattern: the same matches, by the faster library where the text allows it."""

    def spelled(letters: str, digits: str, blank: str) -> str:
        out, inside, i = [], False, 0
        while i < len(pattern):
            two, four = pattern[i : i + 2], pattern[i : i + 5]
            if four in ("\\p{L}", "\\p{N}"):
                chars, i = letters if four[3] == "L" else digits, i + 5
                out.append(chars if inside else f"[{chars}]")
            elif two in ("\\s", "\\S"):
                out.append(blank if inside else f"[{'^' * (two == '\\S')}{blank}]")
                i += 2
            else:
                inside = pattern[i] == "[" or inside and pattern[i] != "]"
                out.append(two if pattern[i] == "\\" else pattern[i])
                i += 1 + (pattern[i] == "\\")
        return "".join(out)

    plain = re.compile(spelled(LETTERS, "0-9", "\\t-\\r "))
    full = regex.compile(spelled("\\p{L}", "\\p{N}", BLANK))
    return lambda text: (full if ODD.search(text) else plain).findall(text)


def quiet_collector() -> None:
    """Let Python's cycle collector skip the tables just loaded, and run rarely in this worker."""
    gc.freeze()
    gc.set_threshold(1_000_000, 50, 50)


class Merges:
    """``rank(a, b)`` gives the priority of joining two symbols, or None.  Symbols are str or bytes."""

    def __init__(self, rank, atoms):
        self.rank, self.atoms = rank, atoms
        self._own: dict = {}

    def encode(self, symbols: list, made: list | None = None) -> list:
        """Join the pair of lowest rank, leftmost first, until none is left; ``made`` gets the joins."""
        symbols, rank = list(symbols), self.rank
        ranks = [rank(a, b) for a, b in zip(symbols, symbols[1:])]
        while True:
            best, at = None, -1
            for i, r in enumerate(ranks):
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                return symbols
            if made is not None:
                made.append((symbols[at], symbols[at + 1]))
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank(symbols[at - 1], symbols[at])
            if at < len(ranks):
                ranks[at] = rank(symbols[at], symbols[at + 1])

    def edges(self, token):
        """None if the token's symbols don't encode to it; else what stands at its right and at its left edge in
        the course of the joins: (symbol, rank that made it, rank that takes it in)."""
        known = self._own.get(token, 0)
        if known == 0:
            made: list = []
            if self.encode(self.atoms(token), made) != [token]:
                known = None
            else:
                tree = {a + b: (a, b) for a, b in made}
                sides = []
                for side in (1, 0):
                    spine, symbol, taken = [], token, NEVER
                    while symbol in tree:
                        own = self.rank(*tree[symbol])
                        spine.append((symbol, own, taken))
                        symbol, taken = tree[symbol][side], own
                    spine.append((symbol, -1, taken))
                    sides.append(spine)
                known = tuple(sides)
            self._own[token] = known
        return known

    def stable(self, token) -> bool:
        return self.edges(token) is not None

    def fits(self, a, b) -> bool:
        """Whether a followed by b stays a, b: no join crosses their border while both of its symbols stand there.
        Of equal ranks the left join comes first."""
        rank = self.rank
        for x, made_x, taken_x in self.edges(a)[0]:
            for y, made_y, taken_y in self.edges(b)[1]:
                r = rank(x, y)
                if r is not None and made_x < r < taken_x and made_y < r <= taken_y:
                    return False
        return True


class Fits(dict):
    """``fits`` of numbered tokens, by first << 20 | second, as far as it was asked for."""

    def __init__(self, merges: Merges, tokens: list, kept: int = 300_000):
        self.merges, self.tokens, self.kept = merges, tokens, kept

    def __missing__(self, key: int) -> bool:
        if len(self) > self.kept:
            self.clear()
        own = self[key] = self.merges.fits(self.tokens[key >> 20], self.tokens[key & 0xFFFFF])
        return own
