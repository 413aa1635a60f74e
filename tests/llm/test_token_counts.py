import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from papyrine.llm import token_counts, vocab

PATH = public_tokenizers.path("word_bpe_49k.json")


def library(text):
    return len(token_counts.tokenizer(PATH).encode(text, add_special_tokens=False))


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \t\n\x0b\x0c\r\x1c\x85\xa0'Σςé́<|>")), max_size=50))
def test_words_count_as_the_whole_text(text):
    assert sum(library(w.decode()) for w in text.encode().split()) == library(text)


def test_special_strings():
    assert library("<|endoftext|>") == 1 == sum(library(w.decode()) for w in b"<|endoftext|>".split())
    for text in ("a<|endoftext|>b c", "<|startoftext|> x", "<|endof text|>"):
        assert sum(library(w.decode()) for w in text.encode().split()) == library(text)


def check(rows, source):
    for text_id, n_bytes, n_tokens, over in rows:
        assert (n_bytes, n_tokens, over) in {(len((t or "").encode()), library(t or ""), library(t or "") > 2048) for i, t in source if i == text_id}


def test_operator(odd, none):
    source = [(r.doc_id, r.text) for r in odd.collect()]
    rows = [tuple(r) for r in token_counts.count_tokens(odd, PATH).collect()]
    assert len(rows) == len(source)
    check(rows, source)
    assert token_counts.count_tokens(none, PATH).count() == 0


def test_rare_words_go_through_the_join(odd, monkeypatch):
    monkeypatch.setattr(vocab, "FLUSH", 3)
    monkeypatch.setattr(vocab, "HEAD", 2)
    monkeypatch.setattr(vocab, "BATCH_ROWS", 5)
    monkeypatch.setattr(token_counts, "BATCH_BYTES", 16)
    source = [(r.doc_id, r.text) for r in odd.collect()]
    rows = [tuple(r) for r in token_counts.count_tokens(odd, PATH).collect()]
    assert len(rows) == len(source)
    check(rows, source)


def test_a_long_word_of_every_document_is_looked_up(spark):
    long = "=" * 3000
    docs = spark.createDataFrame([(i, f"{long} w{i}") for i in range(100)], "doc_id long, text string")
    table = vocab.counts(docs.select("text"), bytes.split)
    assert list(vocab.head_of(table, "n", size=50)) == [long.encode()]
    head = vocab.head_of(table, "n", in_all=2000)
    assert long.encode() not in head and len(head) == 100
    assert vocab.head_of(table, "n", size=0) == {}


def test_tasks_flush_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(vocab, "FLUSH_BYTES", 10)
    docs = spark.createDataFrame([(f"a b c{i}",) for i in range(40)] + [(None,), ("",)], "text string")
    assert {r.word: r.n for r in vocab.counts(docs, bytes.split).collect()} == {"a": 40, "b": 40} | {f"c{i}": 1 for i in range(40)}
