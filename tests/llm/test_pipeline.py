import numpy as np
from fixtures import docs, prose
from test_lines import brute as brute_lines
from test_minhash import brute as brute_components
from test_packing import check

import corpus_pipeline
from ledgerlens.llm import compression, outliers
from ledgerlens.llm.common import stored
from ledgerlens.llm.queries import fold

SF = "/root/testdata/sf0.001"
CHECKS = {}


def checks(f):
    CHECKS[f.__name__] = f
    return f


@checks
def quality_classifier(spark, before, after):
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter(fold() != 0)
    model = compression.fit(spark.createDataFrame(before, DOCS), labels)
    c = compression._compressors(model)
    score = {r["doc_id"]: 1 / (1 + np.exp(-(model.intercept + model.slope * compression.difference(r["text"], c)))) for r in before}
    assert after == [r for r in before if score[r["doc_id"]] >= 0.3]
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    assert len(good & set(score) - {r["doc_id"] for r in after}) <= 1


@checks
def quality_rules(spark, before, after):
    kept = {r["doc_id"] for r in after}
    for r in before:
        words, _, _, _, repeated, *_ = outliers.text_counts(r["text"])
        if words < 20 or 100 * repeated > 30 * words:
            assert r["doc_id"] not in kept
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    clean = {r["doc_id"] for r in before if len(r["text"].encode().split()) >= 20 and r["doc_id"] in good
             and 100 * outliers.text_counts(r["text"])[4] <= 30 * outliers.text_counts(r["text"])[0]}
    assert clean <= kept and kept <= {r["doc_id"] for r in before}


@checks
def line_dedup(spark, before, after):
    want = brute_lines([(r["doc_id"], r["text"]) for r in before])
    left = {d: t for (d, _), (t, _, _) in want.items() if t.split()}
    assert {r["doc_id"]: r["text"] for r in after} == left
    assert all(r["n_chars"] == len(r["text"]) for r in after)


@checks
def minhash_near_dedup(spark, before, after):
    want = brute_components([(r["doc_id"], r["text"]) for r in before], 5)
    assert after == [r for r in before if want[r["doc_id"]][1] == r["doc_id"]]


@checks
def packing(spark, before, after):
    check(after, [(r["doc_id"], r["text"]) for r in before])


def test_every_stage_equals_brute_force_on_its_input(spark):
    global DOCS
    current = spark.read.parquet(f"{SF}/documents.parquet")
    DOCS = current.schema
    for name, stage in corpus_pipeline.STAGES:
        before = sorted(current.collect(), key=lambda r: r["doc_id"])
        out = stored(stage(spark, current, SF), "test-stage")
        if name != "packing":
            assert out.columns == current.columns
        after = sorted(out.collect(), key=lambda r: r["doc_id"])
        assert after
        CHECKS[name](spark, before, after)
        current = out


def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(rows[0].asDict())


def test_stages_on_edge_rows_and_an_empty_table(spark):
    rows = [(100 + i, prose(i, 40), "en", "a") for i in range(30)]
    whole = docs(spark).unionByName(docs(spark, rows))
    for df in (whole, whole.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF)
            n = out.count()
            if name != "packing":
                assert out.columns == df.columns
                assert (n > 0) == (df is whole)
