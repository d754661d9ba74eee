import os

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestack.llm import tokens as K

PATH = K.vocabulary("byte_bpe_50k")
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="the vocabulary is not here")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_words_encode_as_texts(tokenizer, text):
    words = regex.findall(K.PATTERN, text)
    assert "".join(words) == text
    ids = [i for w in words for i in tokenizer.encode(w, add_special_tokens=False).ids]
    assert ids == tokenizer.encode(text, add_special_tokens=False).ids


TEXTS = [None, "", " ", "\n\n\t ", "It's 12 o'clock.", "<|endoftext|> </s>", "日本語 नमस्ते 👩🏽‍⚕️", "x" * 50_000, "a b " * 20_000, "It's 12 o'clock.", "\x01\x00é", "  two  spaces  "]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "x", [1]) for i, t in enumerate(texts)], "doc_id bigint, text string, word string, ids array<int>")


@pytest.mark.parametrize("hot", [1, 4096])
def test_corpus_equals_tokenizer(spark, tokenizer, monkeypatch, hot):
    monkeypatch.setattr(K, "HOT", hot)
    got = {r["doc_id"]: r["ids"] for r in K.encode_corpus(frame(spark), "doc_id", "text", PATH).collect()}
    assert got == {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}
    sizes = {r["doc_id"]: r["n_tokens"] for r in K.encode_corpus(frame(spark), "doc_id", "text", PATH, lengths=True).collect()}
    assert sizes == {i: len(x) for i, x in got.items()}


def test_round_trip(spark):
    encoded = K.encode_corpus(frame(spark), "doc_id", "text", PATH)
    got = {r["doc_id"]: r["text"] for r in K.decode_corpus(encoded, "doc_id", K.token_bytes(spark, PATH.replace(".json", ".tiktoken"))).collect()}
    assert got == {i: t or "" for i, t in enumerate(TEXTS)}


def test_repeated_and_null_keys_and_small_blocks(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(K, "BLOCK_TEXTS", 2)
    df = spark.createDataFrame([("a", "x y"), ("a", "x y"), (None, "z"), ("b", None), ("c", "")], "k string, text string")
    got = sorted((str(r["k"]), tokenizer.decode(r["ids"])) for r in K.encode_corpus(df, "k", "text", PATH).collect())
    assert got == [("None", "z"), ("a", "x y"), ("a", "x y"), ("b", ""), ("c", "")]
    assert K.encode_corpus(df.limit(0), "k", "text", PATH).count() == 0
    assert K.encode_corpus(df.where("text is null"), "k", "text", PATH).first()["ids"] == []


def test_decoding_keeps_rows(spark):
    """Repeated and null keys, empty and null ids, and ids that the vocabulary lacks."""
    table = spark.createDataFrame([(0, b"a".hex()), (1, "é".encode()[:1].hex()), (2, "é".encode()[1:].hex())], "id int, hex string")
    encoded = spark.createDataFrame([(1, [0, 1, 2]), (1, [0]), (None, [0, 0]), (2, []), (3, None), (4, [0, 99, -1, 0]), (5, [1])], "k int, ids array<int>")
    got = sorted(((r["k"], r["text"]) for r in K.decode_corpus(encoded, "k", table).collect()), key=str)
    assert got == sorted([(1, "aé"), (1, "a"), (None, "aa"), (2, ""), (3, ""), (4, "aa"), (5, "\ufffd")], key=str)
    assert K.decode_corpus(encoded.limit(0), "k", table).count() == 0
