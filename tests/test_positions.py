"""Places of sorted rows, without a window over all of them."""

import pytest
from pyspark.sql import functions as F

from ledgerlens import registry
from ledgerlens.operators.positions import with_positions
from ledgerlens.operators import receivables

SF = "/root/testdata/sf0.001"


def _shuffled(spark, n):
    return spark.range(n).select(((F.col("id") * 7919) % 10007).alias("v"), (F.col("id") % 3).alias("g"))


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_places_of_many_partitions(spark, adaptive):
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        df = with_positions(_shuffled(spark, 10007).orderBy(F.col("v").desc()).select("g", "v"))
        got = {r["v"]: r["pos"] for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert got == {v: 10007 - v for v in range(10007)}
    assert df.columns == ["g", "v", "pos"]


def test_by_a_column_that_is_not_shown_and_with_ties(spark):
    df = with_positions(_shuffled(spark, 3000).orderBy("g").select(F.col("g").alias("shown")), "place")
    got = df.collect()
    assert sorted(r["place"] for r in got) == list(range(1, 3001))
    assert [r["shown"] for r in sorted(got, key=lambda r: r["place"])] == [0] * 1000 + [1] * 1000 + [2] * 1000


def test_empty_and_clashing(spark):
    none = _shuffled(spark, 5).filter("v < 0").orderBy("v")
    assert with_positions(none).collect() == []
    with pytest.raises(ValueError, match="POS"):
        with_positions(none.withColumnRenamed("g", "pos"), "POS")


def test_a_report_keeps_its_order(spark):
    t = registry.tables_for(spark, SF)
    report = receivables.at_risk_customers(t, registry.AS_OF)
    placed = sorted(with_positions(report).collect(), key=lambda r: r["pos"])
    assert [r["party_id"] for r in placed] == [r["party_id"] for r in report.collect()]
    assert "Window" not in with_positions(report)._jdf.queryExecution().executedPlan().toString()
