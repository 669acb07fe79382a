import glob
import zlib

import numpy as np
import public_tokenizers
import pytest
from fixtures import docs
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerlens.llm import idcoder
from ledgerlens.llm.common import new_folder

PATH = public_tokenizers.path("word_bpe_49k.json")


def round_trip(ids):
    docs, counts, back = idcoder.unpack_file(idcoder.pack_file([1, None], np.array([len(ids), 0]), ids))
    assert docs == [1, None] and counts.tolist() == [len(ids), 0]
    assert back.dtype == np.uint32 and (back == ids).all() and len(back) == len(ids)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 60_000), max_size=400), st.integers(1, 5))
def test_any_ids(ids, times):
    round_trip(np.array(ids * times, np.uint32))


@pytest.mark.parametrize("kind", ["flat", "constant", "skewed", "periodic", "all"])
def test_blocks_of_every_kind(kind):
    r = np.random.default_rng(2)
    n = 3 * idcoder.BLOCK + 17
    ids = {"flat": r.integers(0, 49_408, n), "constant": np.full(n, 7), "skewed": np.minimum(r.zipf(1.3, n), 49_407),
           "periodic": np.tile(r.integers(0, 49_408, 37), n)[:n], "all": np.arange(60_000)}[kind]
    round_trip(ids.astype(np.uint32))


def test_context_pays():
    r = np.random.default_rng(4)
    phrases = [r.integers(0, 20_000, 30) for _ in range(20)]
    ids = np.concatenate([phrases[k] for k in r.integers(0, 20, 2000)]).astype(np.uint32)
    size = len(idcoder.pack_file([1], np.array([len(ids)]), ids))
    entropy = -sum(p * np.log2(p) for p in np.unique(ids, return_counts=True)[1] / len(ids)) * len(ids) / 8
    assert size < 0.5 * entropy


def test_a_block_decodes_alone():
    r = np.random.default_rng(6)
    blocks = [r.integers(0, 500, n) for n in (4096, 100, 4096, 1)]
    start = idcoder._start_row(np.concatenate(blocks))
    coded = idcoder.code(blocks, start)
    for b, c in zip(blocks, coded, strict=True):
        assert (idcoder.decode([c], np.array([len(b)]), start)[0] == b).all()


def test_the_blocks_of_a_file_advance_together(monkeypatch):
    monkeypatch.setattr(idcoder, "BLOCK", 64)
    steps, update = [], idcoder._Mixture.update
    monkeypatch.setattr(idcoder._Mixture, "update", lambda *a: steps.append(1) or update(*a))
    ids = np.random.default_rng(8).integers(0, 900, 1030 * 64 - 5).astype(np.uint32)
    data = idcoder.pack_file([1], np.array([len(ids)]), ids)
    assert len(steps) == 64
    assert (idcoder.unpack_file(data)[2] == ids).all() and len(steps) == 128


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from([0, 0, 0, 1, 2, 3, 50, 130_000]), max_size=90), min_size=1, max_size=5))
def test_blocks_of_any_lengths(blocks):
    ranks = [np.array(b, np.int64) for b in blocks]
    start = idcoder._start_row(np.concatenate([*ranks, np.arange(130_001)]))
    coded = idcoder.code(ranks, start)
    for want, got in zip(ranks, idcoder.decode(coded, np.array([len(r) for r in ranks]), start), strict=True):
        assert (want == got).all()


@pytest.mark.parametrize("share", [0.0, 0.2, 1e-5])
def test_carries_run_through(share):
    """Nearly certain ids leave long runs of equal words, into which carries go."""
    r = np.random.default_rng(9)
    blocks = [np.where(r.random(4096) < share, r.integers(0, 3, 4096), 0) for _ in range(40)]
    start = idcoder._start_row(np.concatenate([np.zeros(10**6, np.int64), [1, 2]]))
    for want, got in zip(blocks, idcoder.decode(idcoder.code(blocks, start), np.full(40, 4096), start), strict=True):
        assert (want == got).all()


def test_a_file_is_no_longer_than_its_entropy():
    r = np.random.default_rng(10)
    ids = np.minimum(r.zipf(1.3, 1 << 19), 49_407).astype(np.uint32)
    p = np.unique(ids, return_counts=True)[1] / len(ids)
    assert len(idcoder.pack_file([1], np.array([len(ids)]), ids)) * 8 < 1.03 * -(p * np.log2(p)).sum() * len(ids) + 40 * len(p)


def test_damage_is_found():
    data = bytearray(idcoder.pack_file([1], np.array([9000]), np.arange(9000, dtype=np.uint32) % 777))
    data[-3000] ^= 4
    with pytest.raises(ValueError, match="damaged"):
        idcoder.unpack_file(bytes(data))


def test_files_equal_the_library(spark):
    df = docs(spark)
    folder = new_folder(spark, "test-ids")
    folder = folder if ":" in folder.split("/")[0] else f"file://{folder}"
    manifest = idcoder.write_ids(df, folder, PATH, file_ids=5000)
    assert manifest.count() > 2
    got = idcoder.read_ids(spark, folder).orderBy("start").collect()
    rows = sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    t = Tokenizer.from_file(PATH)
    start, want = 0, []
    for d, text in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes()), ids.tolist()))
        start += len(ids)
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) for r in got] == want
    open(glob.glob(folder.removeprefix("file://") + "/*.bin")[0] + ".tmp", "wb").write(b"left over")
    assert idcoder.read_ids(spark, folder).count() == len(want)
    assert idcoder.round_trip(df.limit(0), PATH).count() == 0
