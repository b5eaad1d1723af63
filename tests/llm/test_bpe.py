"""Token counts and byte-level BPE against the libraries themselves, and round trips."""
import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graphloom.llm import byte_bpe, token_counts

WORD, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")
CASES = ["", " ", "\n\n a", "It's we'll I'D 123 don't", "a<|endoftext|>b<|startoftext|>", "İstanbul ΟΔΟΣ", "é é 가나",
         "日本語 テキスト 😀😀‍", "\x85\xa0x y", "aaaaaaaaaaaaaaaaa bbbbb", "ǅ ß ẞ ²½", "x" * 5000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def tik():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def noise(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcthe ’'é<|>ndoftx\n\t123日😀ßÄ.,") for _ in range(rng.randint(0, 80))) for _ in range(n)]


def test_counts_equal_the_library(library):
    tool = token_counts.counter(WORD)
    for text in CASES + noise(400):
        assert tool.total(text) == len(library.encode(text, add_special_tokens=False).ids), text
        got = tool.prefixes(text)
        assert (int(got[-1]) if len(got) else 0) == tool.total(text)


def test_every_prefix_equals_the_library(library):
    tool = token_counts.counter(WORD)
    for text in ["The quick brown-fox jumps, over 12 lazy dogs. ", "thorinthtion été naïve"]:
        text = tool.normal(text)
        got = tool.prefixes(text)
        assert len(got) == len(text)
        for i in range(1, len(text) + 1):
            assert got[i - 1] == len(library.encode(text[:i], add_special_tokens=False).ids), text[:i]


def test_truncation():
    assert token_counts.tokens_within(np.array([1, 1, 2, 3, 2, 3]), 2) == 5
    assert token_counts.tokens_within(np.array([1]), 0) == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_round_trip(text):
    tool, decoder = byte_bpe.transducer(RANKS, P.PATTERN)
    ids = tool.encode(text)
    assert decoder.text(ids) == text


def test_transducer_ids(tik):
    tool, decoder = byte_bpe.transducer(RANKS, P.PATTERN)
    for text in CASES + noise(400):
        ids = tool.encode(text)
        assert ids == tik.encode_ordinary(text), text
        assert decoder.text(ids) == text
    pending = max(len(p) for _, paths in tool.states for p, _ in paths)
    assert pending <= max(map(len, tool.bytes))


def test_stream_in_any_cuts():
    data = "aé日😀z".encode() + b"\xff\xe2\x82" + "x".encode()
    for cut in range(len(data) + 1):
        machine = byte_bpe.Utf8Stream()
        assert machine.feed(data[:cut]) + machine.feed(data[cut:]) + machine.end() == "aé日😀z��x"


def test_frames(spark):
    rows = [(1, "hello world", 7), (1, "hello world", 7), (None, None, 0), (3, "", 1), (4, "word " * 3000, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = {(r.doc_id, r.n_tokens): r for r in token_counts.prefix_counts(docs, WORD, table=True).collect()}
    assert got[(None, 0)].over_limit is False and got[(3, 0)].n_bytes == 0
    assert got[(4, 3000)].over_limit and got[(4, 3000)].cut_chars == 5 * 2048
    assert len(got[(1, 2)].prefix_tokens) == 4 * 11
    out = byte_bpe.encode_documents(docs, RANKS, P.PATTERN)
    assert out.count() == 5
    empty = hashlib.sha256(b"").hexdigest()
    for r in out.collect():
        if not r.n_tokens:
            assert r.ids_sha256 == r.decoded_sha256 == empty
    back = {r.doc_id: r.text for r in byte_bpe.decode_documents(out, RANKS, P.PATTERN).collect()}
    assert back[4] == "word " * 3000 and back[None] == ""
    assert token_counts.prefix_counts(docs.limit(0), WORD).count() == 0
