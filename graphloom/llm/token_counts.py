"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

For a word piece, ``open[i]`` is the last token of the encoding of its first i bytes while more follow, and
``shut[i]`` the number of tokens if the word ended there.  Each entry follows from one shorter entry, so one
pass gives the counts of all prefixes; truncation and budget questions read the table instead of encoding again.
"""
from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from graphloom.llm.bpe import BLANK, ODD, Fits, Merges, quiet_collector, splitter
from graphloom.llm.stores import kept

#: Distinct pieces whose tables a worker keeps in a store; a full store goes back in line, and what is met again moves to
#: the new one, so that common pieces stay.  No result depends on it.
KEPT_PIECES = 200_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Totals(dict):
    """The last entry of each piece's table."""

    def __init__(self, counter: PrefixCounter):
        self.counter = counter

    def __missing__(self, piece: str) -> int:
        own = self[piece] = int.from_bytes(self.counter.kept(piece)[-4:], "little")
        return own


class PrefixCounter:
    """Counts of a word-end BPE (vocabulary file of the tokenizers library) at every prefix."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        pairs = {tuple(p if isinstance(p, list) else p.split(" ")): i for i, p in enumerate(model["merges"])}
        self.merges = Merges(lambda a, b: pairs.get((a, b)), self._atoms)
        number = {c: b for b, c in enumerate(byte_letters())}
        #: Nodes (children by byte, token if the word goes on, token if it ends here), of tokens that encode to themselves.
        self.trie: list = [{}, -1, -1]
        self.tokens = [t for t in model["vocab"] if self.merges.stable(t)]
        self.fits = Fits(self.merges, self.tokens)
        for at, token in enumerate(self.tokens):
            closed, node = token.endswith(self.end), self.trie
            for c in token[: -len(self.end)] if closed else token:
                node = node[0].setdefault(number.get(c, c), [{}, -1, -1])
            node[2 if closed else 1] = at
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.pieces = splitter(f" ?(?:{split})| ")
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.older: dict[str, bytes] = {}
        self.tables: dict[str, bytes] = {}
        self.totals = Totals(self)

    def _atoms(self, token: str) -> list[str]:
        if token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return [*token]

    def normal(self, text: str) -> str:
        """NFC, runs of white space to one blank, each letter lowered on its own."""
        if not ODD.search(text):
            words = " ".join(text.split())
            if text[:1].isspace():
                words = " " + words
            return (words + " " if text[-1:].isspace() and words != " " else words).lower()
        text = WHITE.sub(" ", unicodedata.normalize("NFC", text))
        low = text.lower()
        return "".join([c.lower() for c in text]) if "ς" in low else low

    def table(self, piece: str) -> bytes:
        """Little-endian int32 per letter of the piece: tokens if the piece ended after it (a blank before it: 0)."""
        body = piece.removeprefix(" ")
        word = body.encode("utf-8", "surrogatepass")
        n = len(word)
        last, count, shut = [-1] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        fits, children = self.fits, self.trie[0]
        i, below = 0, children
        for byte in word:
            node = below.get(byte)
            if node is None:
                break
            i += 1
            below, going, ending = node
            if going >= 0:
                last[i], count[i] = going, 1
            if ending >= 0:
                shut[i] = 1
        for j in range(1, n):
            if last[j] < 0:
                continue
            before, reached, i, below = last[j] << 20, count[j] + 1, j, children
            for byte in word[j:]:
                node = below.get(byte)
                if node is None:
                    break
                i += 1
                below, going, ending = node
                if going >= 0 and last[i] < 0 and fits[before | going]:
                    last[i], count[i] = going, reached
                if ending >= 0 and not shut[i] and fits[before | ending]:
                    shut[i] = reached
        if n > len(body):
            shut = [0, *(v for v, byte in zip(shut[1:], [*word[1:], 0]) if byte & 0xC0 != 0x80)]
        return array("i", shut if len(piece) > len(body) else shut[1:]).tobytes()

    def kept(self, piece: str) -> bytes:
        own = self.tables.get(piece)
        if own is None:
            self.tables[piece] = own = self.older.pop(piece, None) or self.table(piece)
        return own

    def _parts(self, text: str) -> list[str]:
        if len(self.tables) > KEPT_PIECES:
            self.older, self.tables, self.totals = self.tables, {}, Totals(self)
        return self.special.split(text) if self.special else [text]

    def prefixes(self, text: str) -> np.ndarray:
        """Tokens of each prefix of the normalised text, by letter.  A special string counts one token, at its last
        letter; before it, and after a blank, the count is that of the text so far."""
        out, base = [], 0
        for i, part in enumerate(self._parts(text)):
            if i % 2:
                own = np.zeros(len(part), np.int64)
                own[-1] = 1
            elif pieces := self.pieces(self.normal(part)):
                inside = np.frombuffer(b"".join(map(self.kept, pieces)), "<i4")
                whole = np.array([*map(self.totals.__getitem__, pieces)])
                own = inside + np.repeat(np.cumsum(whole) - whole, np.fromiter(map(len, pieces), np.int64, len(pieces)))
            else:
                continue
            out.append(own + base)
            base = int(out[-1][-1])
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def total(self, text: str) -> int:
        """The last entry of ``prefixes``, without laying out the rest."""
        n = 0
        for i, part in enumerate(self._parts(text)):
            if i % 2:
                n += 1
            else:
                n += sum(map(self.totals.__getitem__, self.pieces(self.normal(part))))
        return n


#: White space of the vocabulary file's own pattern language.
WHITE = re.compile(f"[{BLANK}]+")


def tokens_within(counts: np.ndarray, budget: int) -> int:
    """Letters of the longest prefix of at most ``budget`` tokens (a longer prefix can have fewer tokens)."""
    fit = np.flatnonzero(counts <= budget)
    return int(fit[-1]) + 1 if len(fit) else 0


@kept
def counter(path: str) -> PrefixCounter:
    quiet_collector()
    return PrefixCounter(path)


def prefix_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text",
                  table: bool = False) -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit, cut_chars (letters of the longest prefix of the normalised
    text within ``limit``; null where the whole text is).

    ``table`` adds ``prefix_tokens``, little-endian int32 counts of every prefix (see ``PrefixCounter.prefixes``).
    Null and empty texts have 0 tokens; repeated rows and ids give a row each; a null id stays null; other columns
    are not read.  Long texts are taken whole, one row at a time.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean, cut_chars long" + ", prefix_tokens binary" * table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(path)
        for batch in batches:
            sizes, counts, cuts, tables = [], [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                sizes.append(len(text.encode()))
                counts.append(tool.total(text))
                got = tool.prefixes(text) if table or counts[-1] > limit else None
                cuts.append(tokens_within(got, limit) if counts[-1] > limit else None)
                if table:
                    tables.append(got.astype("<i4").tobytes())
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_()), pa.array(cuts, pa.int64())]
            names = [id_col, "n_bytes", "n_tokens", "over_limit", "cut_chars"]
            if table:
                columns, names = [*columns, pa.array(tables, pa.binary())], [*names, "prefix_tokens"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
