import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import PROSE, docs, prose

from ledgerlens.llm import minhash
from ledgerlens.llm.queries import op5_bbit_minhash


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) <= width else zip(*(w[i:] for i in range(width)), strict=False))


def brute(rows, width, percent=80):
    """Component of every id by all pairs that share a shingle."""
    sets = {d: shingles(t, width) for d, t in rows}
    by = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    common = Counter((a, b) for own in by.values() for i, a in enumerate(own) for b in own[i + 1:])
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), c in common.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in sets}


def near_copies(seed, n, words=150, edits=3):
    """A chain-like group: copies of copies, each with a few words replaced."""
    r = random.Random(seed)
    texts = [prose(seed, words).split()]
    for _ in range(n - 1):
        t = list(r.choice(texts))
        for _ in range(r.randint(0, edits)):
            t[r.randrange(len(t))] = f"new{r.randrange(10**6)}"
        texts.append(t)
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("width", [2, 5])
def test_components_equal_brute_force(spark, width):
    texts = [prose(i, 80) for i in range(60)] + near_copies(7, 120) + near_copies(8, 12, edits=12) + [prose(3, 80)] * 40
    texts += [f"{prose(99, 20)} {prose(500 + i, 4)}" for i in range(60)]  # many below, some above the threshold
    random.Random(1).shuffle(texts)
    rows = list(enumerate(texts))
    got, names = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=width)
    got = {r["doc_id"]: (r[names["size"]], r[names["component"]]) for r in got.collect()}
    assert got == brute(rows, width)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op5_bbit_minhash(spark, sf).collect()}
    assert got == brute(rows, 2)


def test_bits_estimate_similarity():
    r = np.random.default_rng(5)
    for share in (0.5, 0.8, 0.95):
        both = r.integers(0, 2**63, 2000, dtype=np.uint64)
        k = int(2000 * (1 - share) / (1 + share))
        a, b = both.copy(), both.copy()
        a[:k] = r.integers(0, 2**63, k, dtype=np.uint64)
        ma, mb = (minhash._mix(minhash._minima(x)) & np.uint64(15) for x in (a, b))
        got = (np.mean(ma == mb) - 1 / 16) / (1 - 1 / 16)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(got - true) < 0.17


def test_packed_bits_agree_with_the_estimate(spark):
    import pyarrow as pa

    texts = near_copies(4, 2, words=200, edits=30)
    col = minhash._signature_columns(pa.array(texts), 2, minhash.WordHashes())
    bits = col[4].to_pylist()
    lanes = [[(np.uint64(x % 2**64) >> np.uint64(4 * i)) & np.uint64(15) for x in row for i in range(16)] for row in bits]
    same = np.mean([p == q for p, q in zip(*lanes, strict=True)])
    df = spark.createDataFrame([tuple(bits)], "a array<long>, b array<long>")
    assert df.select(minhash.estimate("a", "b").alias("e")).first()["e"] == pytest.approx((same - 1 / 16) / (1 - 1 / 16))


def test_edge_rows(spark):
    df = docs(spark)
    got, names = minhash.near_duplicates(df, width=2)
    got = got.collect()
    assert len(got) == df.count()
    empty = [r for r in got if r[names["size"]] == 0]
    assert len(empty) == 4 and all(r[names["component"]] == r["doc_id"] for r in empty)
    by = {r["doc_id"]: r[names["component"]] for r in got if r["doc_id"] is not None}
    assert by[5] == 4 and by[9] == 8 and by[6] == 1
    left = minhash.without_duplicates(df, width=2)
    assert left.columns == df.columns
    groups = {r[names["root"]]: r[names["component"]] for r in got if r[names["size"]]}
    assert len(groups) == len({r[names["component"]] for r in got if r[names["size"]]})
    want = list(groups.values()) + [r["doc_id"] for r in empty]
    assert sorted(map(str, want)) == sorted(str(r["doc_id"]) for r in left.collect())
    assert minhash.without_duplicates(df.limit(0)).count() == 0


def test_prose_is_long_enough():
    assert len(PROSE.split()) > 20
