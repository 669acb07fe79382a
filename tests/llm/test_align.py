import hashlib
import json
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from fixtures import docs, edge_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerlens.llm import align, queries
from ledgerlens.llm.common import table
from ledgerlens.llm.tokens import _byte_alphabet

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(BYTE)
    a.encode_special_tokens = True
    with open(BYTE, encoding="utf-8") as f:
        vocab = {i: t for t, i in json.load(f)["model"]["vocab"].items()}
    return a, vocab, sentencepiece.SentencePieceProcessor(model_file=PIECE)


def groups_of(text, libraries):
    """Ids and bytes by the libraries; groups by walking byte by byte."""
    a, vocab, b = libraries
    if not text:
        return None
    byte = _byte_alphabet()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(byte[c] for c in vocab[i]) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return None
    owner_a = [k for k, x in enumerate(bytes_a) for _ in x]
    owner_b = [k for k, x in enumerate(bytes_b) for _ in x]
    links = sorted(set(zip(owner_a, owner_b, strict=True)))
    ends = sorted(set(np.cumsum([len(x) for x in bytes_a]).tolist()) & set(np.cumsum([len(x) for x in bytes_b]).tolist()))
    groups, at = [], 0
    for e in ends:
        groups.append(",".join(str(ids_a[k]) for k in sorted(set(owner_a[at:e]))) + "|" + ",".join(str(ids_b[k]) for k in sorted(set(owner_b[at:e]))))
        at = e
    return len(ids_a), len(ids_b), groups, [(ids_a[x], ids_b[y]) for x, y in links]


def brute(texts, libraries):
    made = [(d, groups_of(t, libraries)) for d, t in texts]
    count = Counter(p for _, g in made if g for p in set(g[3]))
    top = {}
    for (x, _), n in count.items():
        top[x] = max(top.get(x, 0), n)
    return sorted(((d, g[0], g[1], len(g[2]), len(g[3]), sum(count[p] == top[p[0]] for p in g[3]), sum(count[p] for p in g[3]),
                    hashlib.sha256(";".join(g[2]).encode()).hexdigest()) if g else (d, 0, 0, 0, 0, 0, 0, "") for d, g in made), key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


ODD = ["<|endoftext|> plain <s> </s> <0x41>", "a▁b", "▁", " ", "  ", "\n", "\t a \n\n b  c ", "naïve 日本語 テスト 🎉🎉 é́", "x" * 3000, "don't 'll we've", " a b \x1c c\x85d",
       "a  b", "\x00\x01", "1234567 89,000.00", "A" * 70 + " " + "B" * 70 + " tail"]

ends = st.lists(st.integers(1, 400), max_size=60, unique=True)


@settings(max_examples=200, deadline=None)
@given(ends, ends, st.integers(401, 410), st.integers(0, 200))
def test_bounds_and_overlaps(a, b, last, run):
    more = list(range(last + 1, last + run + 1))  # a one-to-one stretch, as long as a probe or longer
    a, b = (np.array([*sorted(x), last, *more], np.int64) for x in (a, b))
    up_a, up_b = align.group_bounds(a, b)
    common = np.intersect1d(a, b)
    assert a[up_a - 1].tolist() == b[up_b - 1].tolist() == common.tolist()
    spans = lambda e: list(zip([0, *e[:-1].tolist()], e.tolist(), strict=True))
    want = [(i, j) for i, x in enumerate(spans(a)) for j, y in enumerate(spans(b)) if max(x[0], y[0]) < min(x[1], y[1])]
    assert list(zip(*(x.tolist() for x in align.overlaps(a, b)), strict=True)) == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab e'sé1 \n\t▁.日<|> \x85") , max_size=30), min_size=1, max_size=5))
def test_stretches_join_to_the_libraries_ids(texts):
    aligner, libs = _aligner(), _libraries()
    rows = aligner.numbers(texts)
    for t, row in zip(texts, rows, strict=True):
        parts = [aligner.groups[k] for k in row]
        want = groups_of(t, libs)
        assert (b"".join(parts).decode() if parts and None not in parts else None) == ("".join(g + ";" for g in want[2]) if want else None)


_KEPT = {}


def _aligner():
    return _KEPT.setdefault("a", align.Aligner(BYTE, PIECE))


def _libraries():
    if "l" not in _KEPT:
        a = Tokenizer.from_file(BYTE)
        a.encode_special_tokens = True
        with open(BYTE, encoding="utf-8") as f:
            _KEPT["l"] = a, {i: t for t, i in json.load(f)["model"]["vocab"].items()}, sentencepiece.SentencePieceProcessor(model_file=PIECE)
    return _KEPT["l"]


def test_awkward_rows(spark, libraries):
    rows = [(d, t, "en", "a") for d, t, *_ in edge_rows()] + [(100 + i, t, "en", "a") for i, t in enumerate(ODD)]
    texts = [(d, t) for d, t, *_ in rows]
    assert got(align.align(docs(spark, rows), BYTE, PIECE)) == brute(texts, libraries)
    assert got(align.align(docs(spark, []), BYTE, PIECE)) == []


def test_slices_and_forgetting_do_not_show(spark, libraries, monkeypatch):
    monkeypatch.setattr(align, "SLICE_TEXTS", 7)
    monkeypatch.setattr(align, "_KEPT", 20)
    run = align._sliced(BYTE, PIECE)  # in this process, where the settings above hold
    import pyarrow as pa
    from pyspark import TaskContext

    monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: type("C", (), {"partitionId": lambda self: 0})()))
    texts = [(i, t) for i, t in enumerate(ODD * 3)]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in texts]), pa.array([t for _, t in texts])], ["doc_id", "text"])
    made = [r for out in run(iter([batch])) for r in out.to_pylist()]
    assert [len(r["doc_id"]) for r in made] == [7, 7, 7, 7, 7, 7, 3]
    want = {r[0]: r for r in brute(texts, libraries)}
    for r in made:
        for k, d in enumerate(r["doc_id"]):
            assert (d, r["n_a"][k], r["n_b"][k], r["n_groups"][k], r["n_links"][k], r["sha"][k]) == (*want[d][:5], want[d][7])


def test_query_against_brute_force(spark, libraries):
    sf = "/root/testdata/sf0.001"
    texts = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    assert got(queries.QUERIES["op13_run_skipping"](spark, sf)) == brute(texts, libraries)
