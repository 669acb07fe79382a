import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from fixtures import edge_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerlens.llm import tokens
from ledgerlens.llm.tokens import ByteEncoder, LetterEncoder, WordEncoder, with_ends

FILES = {"byte_bpe_50k.json": True, "word_bpe_49k.json": False}
ENCODERS = {f: WordEncoder(public_tokenizers.path(f), joins) for f, joins in FILES.items()}
ENCODERS["byte_bpe_50k.json by ranks"] = ByteEncoder(public_tokenizers.path("byte_bpe_50k.json"), special=True)
LIBRARY = {f: Tokenizer.from_file(public_tokenizers.path(f)) for f in FILES}  # as they are

_letters = st.sampled_from(list("abcAZ019 .,'!-\n\t\r\x0b\x1c\x85\xa0 　éÉß́ßжdž世😀️‍▁|<>") + [" "] * 25 + ["'s", "'ll", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "</w>", "the", "ing"])


@pytest.mark.parametrize("name", ENCODERS)
@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.lists(_letters, max_size=40).map("".join), max_size=4))
def test_ids_equal_the_library(name, texts):
    ids, counts = ENCODERS[name].encode_all(texts)
    want = [LIBRARY[name.split()[0]].encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("name", ENCODERS)
def test_edge_texts(name):
    texts = [t or "" for _, t, _, _ in edge_rows()]
    ids, counts = with_ends(*ENCODERS[name].encode_all(texts), 5)
    want = [LIBRARY[name.split()[0]].encode(t, add_special_tokens=False).ids + [5] for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]


@settings(max_examples=100, deadline=None)
@given(texts=st.lists(st.lists(_letters, max_size=40).map("".join), max_size=4))
def test_special_strings_as_plain_text(texts):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    ids, _ = _PLAIN[0].encode_all(texts)
    assert ids.tolist() == [i for t in texts for i in plain.encode(t, add_special_tokens=False).ids]


_PLAIN = [ByteEncoder(public_tokenizers.path("byte_bpe_50k.json"))]


def test_special_strings_become_their_ids():
    text = "abc <|endoftext|> def"
    assert ENCODERS["word_bpe_49k.json"].encode_all([text])[0].tolist() == [5334, 49407, 11649]
    assert ENCODERS["byte_bpe_50k.json by ranks"].encode_all([text])[0].tolist() == [39305, 220, 50256, 825]


def test_nothing():
    ids, counts = with_ends(*ENCODERS["byte_bpe_50k.json"].encode_all([]), 0)
    assert len(ids) == 0 and len(counts) == 0 and ids.dtype == np.uint32


LETTERS = LetterEncoder(public_tokenizers.path("word_bpe_49k.json"))
_words = st.sampled_from(["The", "the", "THE.", "it's", "It'S", "don't...", "x", "X9", "12", "ΑΣ.", "ΑΣ", "İ", "İ", "J̌", "̌", "Å", "Å,", "ﬁ", "ß$$$", "größer", "ÿþ", "é", "ÉTÉ", "éé", "a÷b", "　", "a\u0085b", "a\x0bb", "…", "﻿a", "ⅷ", "ª", "\U0001e900", "a​b", "<|", "", "", "\n", "\t", "\r\n"])


def _as_the_library(encoder, texts):
    ids, counts = encoder.encode_column(pa.array(texts, pa.string()))
    want = [LIBRARY["word_bpe_49k.json"].encode(t or "", add_special_tokens=False).ids for t in texts]
    assert ids.dtype == np.uint32 and counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.none() | st.lists(_letters, max_size=40).map("".join) | st.lists(_words, max_size=12).map(" ".join) | st.text(max_size=30), max_size=4))
def test_columns_equal_the_library(texts):
    _as_the_library(LETTERS, texts)


def test_columns_that_are_slices_or_large():
    texts = ["one Two", None, "three, <|endoftext|> four", "", "five"]
    want = [LIBRARY["word_bpe_49k.json"].encode(t or "", add_special_tokens=False).ids for t in texts[1:4]]
    for kind in (pa.string(), pa.large_string()):
        ids, counts = LETTERS.encode_column(pa.array(texts, kind).slice(1, 3))
        assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]


def test_every_character_by_itself():
    texts = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    _as_the_library(LetterEncoder(public_tokenizers.path("word_bpe_49k.json")), [f"a{t} {t} b{t}c.{t}," for t in texts])


def test_words_are_not_forgotten_while_they_wait(monkeypatch):
    monkeypatch.setattr(tokens, "_LETTER_WORDS_KEPT", 3)
    encoder = LetterEncoder(public_tokenizers.path("word_bpe_49k.json"))
    for text in ("one two three four", "two Five one", "one"):
        _as_the_library(encoder, [text, text.upper()])


def test_new_words_cost_few_library_calls():
    encoder, calls = LetterEncoder(public_tokenizers.path("word_bpe_49k.json")), []
    whole = encoder._ids
    encoder._ids = lambda text: calls.append(text) or whole(text)
    words = [f"wž{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(2000)]
    _as_the_library(encoder, [" ".join(words), "\n".join(f"{w}," for w in words)])
    assert len(calls) <= 5


def test_one_encoder_for_all_tasks_of_a_worker():
    path = public_tokenizers.path("word_bpe_49k.json")
    assert tokens.column_encoder(path, False) is tokens.column_encoder(path, False)
    assert not tokens.letter_file(public_tokenizers.path("byte_bpe_50k.json"))
