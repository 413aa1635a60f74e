import hashlib

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from papyrine.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


REFERENCE = reference()


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_like_the_library(text):
    codec = bpe.codec(PATH, PATTERN)
    ids = codec.encode(text)
    assert ids == REFERENCE.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_odd_texts():
    codec = bpe.codec(PATH, PATTERN)
    for text in ("", " ", "a" * 5000, "\x1c\x1d a\x85b", "<s></s><unk>▁", "don't I'LL we're", "<|endoftext|>", "é" * 99, "\n\n  x  \n"):
        assert codec.encode(text) == REFERENCE.encode_ordinary(text) and codec.decode(codec.encode(text)) == text.encode()


def test_memo_turns_over(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    codec = bpe.Codec(PATH, PATTERN)
    for text in ["one two three four five", "one six seven one", "two two nine ten eleven twelve one"] * 3:
        assert codec.encode(text) == REFERENCE.encode_ordinary(text)
    assert len(codec.memo) + len(codec.older) < 20


def test_ranks_without_gaps():
    import pytest

    with pytest.raises(ValueError):
        bpe.model_proto({b"a": 0, b"b": 2})


def test_operator(odd, none):
    rows = bpe.round_trip(odd, PATH, PATTERN).collect()
    for r, text in zip(rows, [x.text or "" for x in odd.collect()], strict=True):
        ids = REFERENCE.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    back = bpe.decode_documents(bpe.encode_documents(odd, PATH, PATTERN), PATH, PATTERN).collect()
    assert [bytes(b.data).decode() for b in back] == [x.text or "" for x in odd.collect()]
    assert bpe.round_trip(none, PATH, PATTERN).count() == 0 and bpe.encode_documents(none, PATH, PATTERN).count() == 0
