import re

import duckdb
from fixtures import LONG, PROSE, docs, edge_rows
from pyspark.sql import functions as F

from ledgerlens.llm import decontaminate, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(ASCII))


def brute(texts, items, width):
    """The definition: every window of every item at every place."""
    wanted = {}
    for item, text in items:
        w = words(text)
        for s in range(max(0, len(w) - width) + 1) if w else ():
            wanted.setdefault(tuple(w[s:s + width]), set()).add(item)
    out = []
    for d, t in texts:
        w, hit, named = words(t), set(), set()
        for n in {len(x) for x in wanted}:
            for s in range(len(w) - n + 1):
                if owners := wanted.get(tuple(w[s:s + n])):
                    hit.update(range(s, s + n))
                    named |= {str(i) for i in owners if i is not None}
        out.append((d, len(w), len(hit), len(named), sorted(named)))
    return sorted(out, key=str)


def got(df):
    rows = df.collect()
    for r in rows:  # the stretches are sorted, disjoint and as long as n_hit
        s = [tuple(x) for x in r.stretches]
        assert s == sorted(s) and all(a[1] <= b[0] for a, b in zip(s, s[1:], strict=False)) and sum(b - a for a, b in s) == r.n_hit
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r["items"]) for r in rows), key=str)


ITEMS = [(1, PROSE), (2, PROSE + " more"), (2, "Second text of ITEM two, which has eleven words and so on"), (3, "one"), (4, "É ü"), (5, None), (6, ""),
         (None, "ends with blank"), (7, "- . \x00"), (9, "word0x0 word1x1 word2x2 word3x3 word4x4 word5x5 word6x6 word7x7 word8x8 word9x9 word10x10"),
         (10, "a a a a a a a a a a a a"), (11, "never seen anywhere in any of the texts at all today"), (12, "the quick")]


def items(spark, rows=ITEMS):
    return spark.createDataFrame([(*r, "x") for r in rows], "item_id long, text string, wid string")


def texts():
    more = [(20, "x " + PROSE.upper() + " y"), (21, PROSE[:-7]), (22, "a " * 25), (23, "é Ü É ü"), (24, PROSE.replace(" ", "--\n")), (25, PROSE + " " + PROSE),
            (25, PROSE + " " + PROSE), (26, "second text of item two, which has eleven WORDS and"), (27, LONG + " one"), (28, "\u212a one \u017f")]
    return [(d, t) for d, t, *_ in edge_rows()] + more


def test_against_brute_force_with_awkward_rows(spark):
    frame = docs(spark, [(d, t, "en", "a") for d, t in texts()])
    for width, shingle in ((10, 3), (10, 1), (3, 2), (1, 3)):
        found = got(decontaminate.contamination(frame, items(spark), width, shingle))
        assert found == brute(texts(), ITEMS, width)


def test_empty_tables(spark):
    frame = docs(spark, [(1, PROSE, "en", "a"), (2, None, None, None)])
    assert got(decontaminate.contamination(frame, items(spark, []))) == [(1, len(words(PROSE)), 0, 0, []), (2, 0, 0, 0, [])]
    assert got(decontaminate.contamination(docs(spark, []), items(spark))) == []


def test_no_python_in_the_plan(spark):
    plan = decontaminate.contamination(docs(spark), items(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_results_hold_without_broadcasts(spark):
    frame = docs(spark, [(d, t, "en", "a") for d, t in texts()])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert got(decontaminate.contamination(frame, items(spark))) == brute(texts(), ITEMS, 10)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lowering_is_ascii_only(spark):
    row = spark.createDataFrame([("ABC \u00c9 \u0130 \u212a z",), ("ABC z",)], "t string").select(F.array_join(decontaminate.words_of(F.col("t")), " ").alias("w")).collect()
    assert [r.w for r in row] == ["abc \u00c9 \u0130 \u212a z", "abc z"]


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES["op12_prefix_windows"](spark, sf)
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLE_SQL['op12_prefix_windows']})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want) and any(r[-1] for r in want)
