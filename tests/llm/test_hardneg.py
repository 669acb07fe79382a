import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm import hardneg, queries

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", T.IntegerType()),
                       T.StructField("embedding", T.ArrayType(T.FloatType())),
                       *(T.StructField(c, T.StringType()) for c in ("rid", "anchor", "dim", "deal", "rank", "ab"))])
NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", None, "1", "", None, "no") for r in rows], SCHEMA)


def brute(rows, every=10):
    """The definition, row by row."""
    usable = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        r = (i, label, tuple(np.float32(x).item() + 0.0 for x in v))
        if r not in usable:
            usable.append(r)
    whole = {r: [int(np.floor(256 * x)) for x in r[2]] for r in usable}
    score = lambda r, s: sum(x * y for x, y in zip(whole[r], whole[s], strict=True))
    out = []
    for a in usable:
        if a[0] % every:
            continue
        others = [(score(a, r), r) for r in usable if r != a and len(r[2]) == len(a[2])]
        order = lambda x: (-x[0], x[1][0])
        for p, pos in sorted((x for x in others if x[1][1] == a[1]), key=order)[:5]:
            window = sorted((x for x in others if x[1][1] != a[1] and 30 * p <= 100 * x[0] <= 90 * p), key=order)[:10]
            out += [(a[0], pos[0], k, n[0], p, s) for k, (s, n) in enumerate(window, 1)]
    return sorted(out)


def got(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert dict(df.dtypes)["rank"] == "int"
    return sorted(tuple(r) for r in df.collect())


whole = st.integers(-300, 300)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9).flatmap(lambda d: st.tuples(st.lists(st.lists(whole, min_size=d, max_size=d), min_size=1, max_size=5),
                                                     st.lists(st.lists(whole, min_size=d, max_size=d), min_size=1, max_size=9))),
       st.sampled_from([1, 1000, 10**6, 10**9, 2**43]))
def test_packed_scores_are_the_inner_products(vectors, scale):
    a, r = (np.array(x, np.int64) * scale for x in vectors)
    want = [[sum(x * y for x, y in zip(p, q, strict=True)) for q in r.tolist()] for p in a.tolist()]
    clipped = [[max(-(2**63 - 1), min(2**63 - 1, s)) for s in row] for row in want]
    assert hardneg.packed_scores(a, r).tolist() == clipped


def test_awkward_rows_ties_and_lengths(spark):
    g = np.random.default_rng(5)
    rows = [(i, int(g.integers(0, 3)), (g.integers(-4, 5, 6) / 8).tolist()) for i in range(120)]
    rows += [(i, 1, [0.5] * 6) for i in range(200, 230)]  # ties
    rows += [(10, 1, [0.25] * 6), (10, 1, [0.25] * 6), (10, 2, [0.25] * 6)]  # repeated ids and rows
    rows += [(None, 1, [1.0] * 6), (300, None, [1.0] * 6), (310, 1, None), (320, 1, [None] * 6), (330, 1, [NAN] * 6), (340, 2, [INF] * 6)]
    rows += [(400, 1, []), (401, 1, []), (402, 2, []), (410, 1, [1.0, 2.0]), (411, 1, [1.0, 1.0]), (412, 2, [1.0, 0.5])]
    rows += [(-10, 0, [-0.0] * 6), (420, 0, [3e4] * 6), (421, 0, [3e4, -3e4] * 3), (422, 1, [2e4] * 6)]
    found = got(hardneg.mine(frame(spark, rows), F.col("id") % 10 == 0))
    assert len(found) > 200 and found == brute(rows)


@pytest.mark.parametrize("sizes", [(40, 20), (1000, 7)])
def test_blocks_do_not_show(spark, monkeypatch, sizes):
    g = np.random.default_rng(6)
    rows = [(i, int(g.integers(0, 2)) if i % 3 else 0, g.normal(0, 0.3, 5).tolist()) for i in range(90)]
    monkeypatch.setattr(hardneg, "ROW_BLOCK", sizes[0])
    monkeypatch.setattr(hardneg, "ANCHOR_BLOCK", sizes[1])
    monkeypatch.setattr(hardneg, "_SCORES", 33)
    assert got(hardneg.mine(frame(spark, rows), F.col("id") % 10 == 0)) == brute(rows)


def test_huge_components_and_empty_tables(spark):
    rows = [(0, 1, [3e38, 1.0]), (1, 1, [2e38, 1.0]), (2, 2, [1e30, 5.0]), (3, 2, [0.5, 0.5])]
    assert got(hardneg.mine(frame(spark, rows), F.col("id") == 0)) == []  # scores beyond a long are equal, outside the window
    assert got(hardneg.mine(frame(spark, []), F.col("id") % 10 == 0)) == []
    assert got(hardneg.mine(frame(spark, rows[:1]), F.col("id") == 0)) == []


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = sorted(con.sql("SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM (" + queries.ORACLE_SQL["op11_kronecker_negatives"] + ")").fetchall())
    assert want and got(queries.QUERIES["op11_kronecker_negatives"](spark, sf)) == want
