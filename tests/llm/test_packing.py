import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from fixtures import docs, edge_rows, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerlens.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 256), min_size=1, max_size=120), st.integers(1, 12))
def test_difference_is_a_partition(sizes, m):
    at = packing.difference(np.array(sizes), m)
    assert len(at) == len(sizes) and at.min() >= 0 and at.max() < m


def test_two_way_differencing_by_hand():
    sizes = np.array([8, 7, 6, 5, 4])  # 8-7=1, 6-5=1, 4-1=3, 3-1=2
    sums = np.bincount(packing.difference(sizes, 2), weights=sizes)
    assert abs(sums[0] - sums[1]) == 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 256), min_size=1, max_size=300))
def test_windows_hold_at_most_the_capacity(sizes):
    s = np.array(sizes)
    sums = np.bincount(packing.windows(s, 1024), weights=s)
    assert sums.max() <= 1024 and sums.sum() == s.sum()


def test_windows_are_level():
    s = np.random.default_rng(3).integers(100, 257, 2000)
    sums = np.bincount(packing.windows(s, 1024), weights=s)
    assert sums.max() - sums.min() <= 64 and s.sum() / (1024 * len(sums)) > 0.96


def check(rows, texts):
    """Every id in one piece, sequences gapless and at most 1,024 long."""
    t = Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for d, text in texts:
        want[d].append(np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4"))
    sequences, got = defaultdict(list), defaultdict(lambda: defaultdict(int))
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        got[r["doc_id"]][(r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])] += 1
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
    for d, own in want.items():
        pieces = defaultdict(int)
        for ids in own:
            start = 0
            for n in packing.cuts(len(ids), 1024, packing.PIECE).tolist():
                pieces[(start, n, zlib.crc32(ids[start:start + n].tobytes()), len(ids))] += 1
                start += n
            assert start == len(ids)
        assert got[d] == pieces
    assert set(got) == set(want)
    return sequences


def test_every_id_once_and_little_padding(spark):
    texts = [(i, prose(i, 20 + 7 * (i % 90))) for i in range(400)]
    rows = packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), PATH, group=300).collect()
    sequences = check(rows, texts)
    total = sum(n for s in sequences.values() for _, n in s)
    assert total / (1024 * len(sequences)) > 0.96


def test_full_windows_have_numbers_of_their_own(spark):
    long = " ".join(prose(i, 400) for i in range(30))
    texts = [(i, long if i % 2 else "a <|endoftext|> b " + prose(i, 300)) for i in range(12)]
    rows = packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), PATH, group=4).collect()
    sequences = check(rows, texts)
    full = [s for s in sequences.values() if s == [(0, 1024)]]
    assert len(full) >= 6 * 5 and len({r["sequence_id"] for r in rows if r["length"] == 1024}) == sum(r["length"] == 1024 for r in rows)


def test_edge_rows(spark):
    rows = packing.pack(docs(spark), PATH).collect()
    check(rows, [(d, t) for d, t, _, _ in edge_rows()])
    assert packing.pack(docs(spark).limit(0), PATH).count() == 0
