import hashlib

import numpy as np
import public_tokenizers
import sentencepiece
from fixtures import docs, edge_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm.pieces import PieceEncoder, encode

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
ENCODER = PieceEncoder(PATH)
_parts = st.sampled_from(list("abethniosr  ▁.,\n\t\r\x00\x1c\xa0　éßж世😀́") + [" "] * 8 + ["the", "th", "aaa", "ing", "====", "    ", "<s>", "<0x41>", "ﬁ", "Ａ"])


def want(text):
    ids = LIBRARY.encode(text, add_bos=True, add_eos=True)
    return ids, LIBRARY.decode(ids)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.lists(_parts, max_size=30).map("".join), max_size=4))
def test_ids_and_text_equal_the_library(texts):
    ids, decoded = ENCODER.encode_all(texts)
    for t, i, d in zip(texts, ids, decoded, strict=True):
        ref, back = want(t)
        assert i.tolist() == ref and d.decode() == back


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aetho=-*.", max_size=80))
def test_long_runs_equal_the_library(text):
    ids, _ = ENCODER.encode_all([text])
    assert ids[0].tolist() == want(text)[0]


def test_a_long_text_without_blanks():
    r = np.random.default_rng(0)
    text = "".join(r.choice(list("etaoinsh"), 20_000))
    assert ENCODER.encode_all([text])[0][0].tolist() == want(text)[0]


def test_query_columns_and_edge_rows(spark):
    got = sorted(map(tuple, encode(docs(spark), PATH).collect()), key=str)
    ref = []
    for d, t, _, _ in edge_rows():
        ids, back = want(t or "")
        ref.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(ref, key=str)
    assert encode(docs(spark).limit(0), PATH).count() == 0
