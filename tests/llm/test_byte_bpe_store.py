"""The transducer's store."""
import public_tokenizers
from graphloom.llm import byte_bpe


def test_a_store_of_a_corpus_vocabulary_is_kept_and_a_full_one_changes_no_ids(monkeypatch):
    tool = byte_bpe.Transducer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    text = "Ein Wortschatz, größer als 300000 Übergänge: zyxwvut 12345 éé \U0001f600 qqqqjjjj"
    want = tool.encode(text)
    tool.arcs.update(dict.fromkeys(range(-400_000, 0)))
    tool.pieces.clear()
    assert tool.encode(text) == want
    assert len(tool.arcs) > 400_000
    monkeypatch.setattr(byte_bpe, "KEPT_ARCS", 3)
    monkeypatch.setattr(byte_bpe, "KEPT_PIECES", 2)
    for _ in range(2):
        assert tool.encode(text) == want
        assert len(tool.arcs) < 1000
