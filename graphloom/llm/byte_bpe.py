"""Byte-level BPE by a lazily determinised transducer, and streaming decode.

The merges define a nondeterministic transducer: a path is an encoding of some prefix followed by a walk in the
token trie.  A state of the determinised machine holds the paths still alive after the bytes read, less the tokens
that all of them share; those are emitted.  Paths die within the length of a token, so lookahead is bounded.  States
and arcs are made when first met and kept; the store is emptied when it is full, which changes no result.
"""
from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.bpe import Fits, Merges, quiet_collector, splitter
from graphloom.llm.stores import kept

#: Entries kept by a worker, some 300 MB together when full (``stores.release`` drops them).
KEPT_ARCS, KEPT_PIECES = 600_000, 500_000


class Transducer:
    """Encoder for one rank file (base64 token and rank per line)."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        ranks = self.ranks
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        self.text = [str(i) for i in range(len(self.bytes))]
        self.merges = Merges(lambda a, b: ranks.get(a + b), lambda t: [t[i : i + 1] for i in range(len(t))])
        self.trie: dict[int, int] = {}
        self.token: list[int] = [-1]
        inner = set()
        self.fits = Fits(self.merges, self.bytes)
        for token, i in ranks.items():
            if not self.merges.stable(token):
                continue
            node = 0
            for b in token:
                inner.add(node)
                key = node << 8 | b
                node = self.trie.get(key) or self.trie.setdefault(key, len(self.token))
                if node == len(self.token):
                    self.token.append(-1)
            self.token[node] = i
        self.inner = inner
        self.split = splitter(pattern)
        self.pieces: dict[str, tuple[int, ...]] = {}
        self._reset()

    def _reset(self) -> None:
        #: A state is held flat: the last token emitted, then pending tokens and node of each path.
        self.flat = [(-1, (), 0)]
        self.number = {self.flat[0]: 0}
        #: The state that an arc leads to, and its tokens among ``emits``; ~ of the state where it has some.
        self.arcs: dict[int, int] = {}
        self.emits: dict[int, tuple[int, ...]] = {}

    @property
    def states(self) -> list[tuple[int, tuple[tuple[tuple[int, ...], int], ...]]]:
        """The states met so far: the last token emitted, and (pending tokens, node) of each path."""
        return [(last, tuple(zip(paths[::2], paths[1::2]))) for last, *paths in self.flat]

    def _arc(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        last, *paths = self.flat[state]
        alive, whole, step, inner, ends = [], None, self.trie.get, self.inner, self.token
        for pending, node in zip(paths[::2], paths[1::2]):
            child = step(node << 8 | byte)
            if child is None:
                continue
            if child in inner:
                alive.append((pending, child))
            if whole is None:
                i = ends[child]
                if i >= 0:
                    before = pending[-1] if pending else last
                    if before < 0 or self.fits[before << 20 | i]:
                        whole = (*pending, i)
        shared = len(whole)
        for p, _ in alive:
            if len(p) < shared:
                shared = len(p)
            while shared and p[:shared] != whole[:shared]:
                shared -= 1
            if not shared:
                break
        out = whole[:shared]
        last = out[-1] if out else last
        alive.append((whole, 0))
        flat = [last]
        for p, n in alive:
            flat += (p[shared:], n)
        if () not in flat[1::2]:
            flat[0] = -1
        key = tuple(flat)
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.flat)
            self.flat.append(key)
        return number, out

    def piece(self, piece: bytes) -> tuple[int, ...]:
        """Tokens of one match of the pattern; a match that is a token itself is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        if len(self.arcs) > KEPT_ARCS:
            self._reset()
        out: list[int] = []
        state, arcs = 0, self.arcs
        for byte in piece:
            key = state << 8 | byte
            state = arcs.get(key)
            if state is None:
                state, emitted = self._arc(key >> 8, byte)
                if emitted:
                    state = ~state
                    self.emits[key] = emitted
                arcs[key] = state
            if state < 0:
                state = ~state
                out += self.emits[key]
        out += self.flat[state][-2]
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        pieces, known = self.split(text), self.pieces
        if len(known) > KEPT_PIECES:
            known.clear()
        for p in {*pieces}.difference(known):
            known[p] = self.piece(p.encode("utf-8"))
        return list(chain.from_iterable(map(known.__getitem__, pieces)))


class Utf8Stream:
    """Incremental UTF-8: feed bytes in any cuts, get the text of the characters that are complete.

    ``need`` is the number of bytes that the open character still lacks, with the range its next byte must have;
    a byte that breaks the rules ends the open character with U+FFFD and is read again as a first byte.
    """

    def __init__(self):
        self.open, self.need, self.low, self.high = b"", 0, 0x80, 0xBF

    @staticmethod
    def _lead(b: int) -> tuple[int, int, int] | None:
        """(bytes to follow, least and largest second byte), or None where no character begins."""
        if b < 0x80:
            return 0, 0, 0
        if 0xC2 <= b <= 0xDF:
            return 1, 0x80, 0xBF
        if 0xE0 <= b <= 0xEF:
            return 2, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF
        if 0xF0 <= b <= 0xF4:
            return 3, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF
        return None

    def feed(self, data: bytes) -> str:
        if not self.need and data.isascii():
            return data.decode("ascii")
        out: list[str] = []
        for b in data:
            if self.need:
                if self.low <= b <= self.high:
                    self.open += bytes((b,))
                    self.need, self.low, self.high = self.need - 1, 0x80, 0xBF
                    if not self.need:
                        out.append(self.open.decode("utf-8"))
                        self.open = b""
                    continue
                out.append("�")
                self.open, self.need = b"", 0
            lead = self._lead(b)
            if lead is None:
                out.append("�")
            elif not lead[0]:
                out.append(chr(b))
            else:
                self.open, (self.need, self.low, self.high) = bytes((b,)), lead
        return "".join(out)

    def end(self) -> str:
        rest, self.open, self.need = "�" * bool(self.open), b"", 0
        return rest


class Decoder:
    """Text of a stream of ids.  Tokens that begin and end between characters are decoded by look-up; from a token
    that leaves a character open, the state machine reads on until no character is open."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.clean: list[str | None] = []
        for t in tokens:
            machine = Utf8Stream()
            text = machine.feed(t)
            self.clean.append(text if not machine.open and "�" not in text or t == "�".encode() else None)

    def feed(self, ids, machine: Utf8Stream) -> str:
        """Text that these ids complete; the machine holds what stays open for the next call."""
        out, clean, tokens = [], self.clean, self.tokens
        for i in ids:
            text = clean[i]
            out.append(text if text is not None and not machine.need else machine.feed(tokens[i]))
        return "".join(out)

    def text(self, ids) -> str:
        out = list(map(self.clean.__getitem__, ids))
        if None in out:
            machine = Utf8Stream()
            return self.feed(ids, machine) + machine.end()
        return "".join(out)


@kept
def transducer(path: str, pattern: str) -> tuple[Transducer, Decoder]:
    tool = Transducer(path, pattern)
    quiet_collector()
    return tool, Decoder(tool.bytes)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                     ids: bool = True) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256 and, with ``ids``, the token ids (array<int>).

    Null and empty texts have no tokens (hashes of the empty string); repeated rows and ids give a row each; a null
    id stays null; other columns are not read.  Texts are encoded and decoded whole, a row at a time.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, decoder = transducer(path, pattern)
        shown = tool.text
        for batch in batches:
            for part in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                n, first, second, lists = [], [], [], []
                for value in part.column(1):
                    got = tool.encode(value.as_py() or "")
                    n.append(len(got))
                    first.append(hashlib.sha256(" ".join(map(shown.__getitem__, got)).encode()).hexdigest())
                    second.append(hashlib.sha256(decoder.text(got).encode()).hexdigest())
                    if ids:
                        lists.append(np.array(got, np.int32))
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    columns, names = [*columns, pa.array(lists, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and the text of its ids.  A null list gives an empty text; bytes that are no UTF-8 give U+FFFD."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder = transducer(path, pattern)
        for batch in batches:
            texts = [decoder.text(v.as_py() or []) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")
