import numpy as np
import pytest
from fixtures import docs
from pyspark.sql import functions as F

from ledgerlens.llm import compression
from ledgerlens.llm.queries import op3_compression_classifier

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = op3_compression_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").collect()
    right = np.mean([r["predicted"] == r["quality"] for r in got])
    bad = [r["score"] for r in got if r["quality"] == 0]
    good = [r["score"] for r in got if r["quality"] == 1]
    auc = np.mean([g > b for g in good for b in bad])
    assert len(bad) > 5 and right >= 0.95 and auc >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_curve_recovers_probabilities():
    r = np.random.default_rng(1)
    x = r.normal(0, 0.02, 20_000)
    y = (r.random(20_000) < 1 / (1 + np.exp(-(0.5 + 80 * x)))).astype(float)
    a, b = compression.fit_curve(x, y)
    assert a == pytest.approx(0.5, abs=0.1) and b == pytest.approx(80, rel=0.1)


def test_difference_is_summed_over_whole_text():
    good, bad = b"lorem ipsum dolor sit amet " * 50, b"#### $$$$ %%%% &&&& " * 50
    c = compression._compressors(compression.Model(good, bad, 0, 1))
    text = "lorem ipsum dolor " * 1000 + "#### $$$$ " * 5000
    blocks = [text.encode()[i:i + compression.BLOCK] for i in range(0, len(text), compression.BLOCK)]
    g, b = (sum(len(x.compress(k)) for k in blocks) for x in c)
    assert compression.difference(text, c) == (b - g) / (b + g)


def test_edge_rows(spark):
    df = docs(spark)
    labels = spark.createDataFrame([(1, 1), (6, 1), (10, 1), (4, 0), (5, 0), (12, 0), (None, 1), (3, None), (8, 7), (1, 1)], "doc_id long, quality int")
    model = compression.fit(df, labels)
    scored, name = compression.scored(df, model)
    got = scored.collect()
    assert name not in df.columns and len(got) == df.count() and all(0 <= r[name] <= 1 for r in got)
    empty = {r[name] for r in got if not r["text"]}
    assert empty == {1 / (1 + np.exp(-model.intercept))}
    none = compression.fit(df, labels.filter("quality = 1"))
    assert compression.scored(df, none)[0].filter(F.col(name) != 0.5).count() == 0
    assert compression.scored(df.limit(0), model)[0].count() == 0
