import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
from tidemark.llm import bpe  # noqa: E402


@pytest.fixture(scope="module")
def auto():
    return bpe.automaton(bpe.default_vocabulary())


@pytest.fixture(scope="module")
def peer():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.default_vocabulary(), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_same_ids_as_the_public_library_and_round_trip(auto, peer, text):
    ids = auto.encode(text)
    assert ids == peer.encode_ordinary(text)
    assert auto.decode(ids) == text


def test_long_word(auto, peer):
    text = "".join("morphoplastational" for _ in range(400)) + "ยืนยันการกระจาย" * 50
    assert auto.encode(text) == peer.encode_ordinary(text)


def test_special_strings_are_ordinary_text(auto, peer):
    assert auto.encode("<|endoftext|>") == peer.encode_ordinary("<|endoftext|>")
    assert 50256 not in auto.encode("<|endoftext|>")


def test_corpus(spark, auto):
    rows = [(1, "a b"), (2, None), (3, ""), (3, ""), (None, "x")]
    df = spark.createDataFrame([(i, t, "shadow", 0) for i, t in rows], "doc_id bigint, text string, ids string, id int")
    got = bpe.encode_corpus(df).collect()
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(i), auto.encode(t)) for i, t in rows)
    assert bpe.encode_corpus(df.where("false")).count() == 0
