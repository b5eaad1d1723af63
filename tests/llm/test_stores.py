"""What workers keep from stage to stage."""
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from graphloom.llm import byte_bpe, jaccard_join, stores


@pytest.fixture
def encoder():
    tool, _ = byte_bpe.transducer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    tool.encode("what an earlier stage encoded")
    yield tool
    byte_bpe.transducer.cache_clear()


def test_a_task_of_another_operator_drops_the_stores_of_the_encoder(encoder):
    texts = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a b c d e f", None])], ["id", "text"])
    assert byte_bpe.transducer.cache_info().currsize == 1
    sizes = np.concatenate([np.diff(bounds) for _, _, bounds, _, _ in jaccard_join._each(iter([texts]), 5)])
    assert sizes.tolist() == [2, 0]
    assert byte_bpe.transducer.cache_info().currsize == 0


def test_an_operator_keeps_its_own_store(encoder):
    stores.release(but=byte_bpe.transducer)
    assert byte_bpe.transducer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)[0] is encoder


def test_states_of_the_transducer_are_flat(encoder):
    encoder.encode("zyxwvut qqqqjjjj größer unwahrscheinlichkeiten")
    assert len(encoder.flat) > 10
    for last, *paths in encoder.flat:
        assert isinstance(last, int) and len(paths) % 2 == 0 and paths[-1] == 0
    assert all(isinstance(arc, int) for arc in encoder.arcs.values())
