import duckdb
from fixtures import PROSE, docs, prose
from pyspark.sql import functions as F

from ledgerlens.llm import lines
from ledgerlens.llm.queries import ORACLE_SQL, op10_line_neighbourhood


def words(line):
    return line.encode().split()


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows, near_words=lines.NEAR_WORDS):
    """Per (id, text): kept text, exact and near drops, by all pairs of lines."""
    rows = sorted({(d, t) for d, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    split = [(d, t, k, line, words(line)) for d, t in rows for k, line in enumerate(t.split("\n"))]
    first = {}
    for i, (*_, w) in enumerate(split):
        first.setdefault(tuple(w), i)
    distinct = [(i, list(w)) for w, i in first.items() if len(w) >= near_words]
    near = {tuple(w) for i, w in distinct if any(j < i and within_one(v, w) for j, v in distinct)}
    out = {}
    for i, (d, t, _, line, w) in enumerate(split):
        kept, exact, close = out.setdefault((d, t), ([], [], []))
        if w and first[tuple(w)] < i:
            exact.append(line)
        elif tuple(w) in near:
            close.append(line)
        else:
            kept.append(line)
    return {k: ("\n".join(a), len(b), len(c)) for k, (a, b, c) in out.items()}


def run(df, **options):
    out, names = lines.line_dedup(df, **options)
    return out, {(r["doc_id"], r["text"]): (r[names["text"]], r[names["exact"]], r[names["near"]], r[names["emptied"]]) for r in out.collect()}


def variants(seed, n=24):
    base = prose(seed, n).split()
    return [" ".join(w) for w in (base, base[:5] + ["other"] + base[6:], base[:5] + base[6:], base[:9] + ["more"] + base[9:], base[1:], base[:-1],
                                  ["x"] + base[1:], base + ["y"], base[:3] + ["p", "q"] + base[5:], base[1:] + ["z"], base[::-1])]


def test_equals_brute_force(spark):
    texts = ["\n".join(variants(s)[k:] + [prose(s, 4)]) for s in range(6) for k in range(0, 11, 3)]
    texts += ["\n".join(variants(50 + i, 10 + i)) for i in range(15)] + ["same short\nline", "line\nsame short", "  spaced   out\nspaced out"]
    hot = prose(77, 30).split()
    texts += [" ".join(hot[:8] + [f"n{i}"] + hot[9:]) + f"\nown {i}" for i in range(300)]
    rows = list(enumerate(texts))
    _, got = run(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {k: v[:3] for k, v in got.items()} == brute(rows)
    assert sum(v[2] for v in got.values()) > 300


def test_lines_beyond_the_array_form(spark, monkeypatch):
    monkeypatch.setattr(lines, "ARRAY_WORDS", 20)
    texts = variants(1, 21) + variants(2, 60) + variants(3, 12)
    rows = list(enumerate(texts))
    _, got = run(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {k: v[:3] for k, v in got.items()} == brute(rows)


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.sql(ORACLE_SQL["op10_line_neighbourhood"]).fetchall())
    assert sorted(map(tuple, op10_line_neighbourhood(spark, sf).collect())) == want


def test_edge_rows(spark):
    df = docs(spark).unionByName(docs(spark, [(20, PROSE + "\n", "en", "a"), (None, PROSE, None, None)]))
    out, got = run(df)
    assert set(df.columns) <= set(out.columns) and out.count() == df.count()
    want = brute([(r["doc_id"], r["text"]) for r in df.collect()])
    assert {k: v[:3] for k, v in got.items() if k[1] is not None} == want
    assert all(v == (None, 0, 0, False) for k, v in got.items() if k[1] is None)
    assert {k[0] for k, v in got.items() if v[3]} == {d for (d, t), v in want.items() if t.split() and not v[0].split()}
    assert lines.line_dedup(df.limit(0))[0].count() == 0


def test_plan_stays_in_the_jvm(spark):
    df = spark.createDataFrame([(1, PROSE)], "doc_id long, text string")
    plan = lines.line_dedup(df)[0]._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian"))


def test_hash_columns_do_not_leak(spark):
    df = spark.createDataFrame([(1, PROSE)], "doc_id long, text string").withColumn("line_rid", F.lit("mine"))
    out, _ = lines.line_dedup(df)
    assert out.first()["line_rid"] == "mine"


def test_places_move_once(spark, monkeypatch):
    """Keys of lines are joined without their places, and one exchange finds the insertions."""
    plans, kept = {}, lines.stored

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return kept(df, name)

    monkeypatch.setattr(lines, "stored", noted)
    text = " ".join(f"w{i}" for i in range(12))
    df = spark.createDataFrame([(1, text), (2, text + " more"), (3, "a line\n" + text), (4, "a line")], "doc_id long, text string")
    out, names = lines.line_dedup(df)
    assert {r["doc_id"]: (r[names["exact"]], r[names["near"]]) for r in out.collect()} == {1: (0, 0), 2: (0, 1), 3: (1, 0), 4: (1, 0)}
    assert not [n for n, p in plans.items() if "explode(keys" in p and "rid#" in p]
    assert plans["lines-indels"].count("Exchange") == 1
