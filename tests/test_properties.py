"""Property tests of the scalar rules against plain-Python statements of the
JavaScript / PostgreSQL semantics they reproduce."""

import math
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.functions import exprs as X


def _js_round(x: float) -> int:
    return math.floor(x + 0.5)


def _fmt(m):
    if m is None:
        return None
    h = m // 60 if m >= 0 else -((-m) // 60) - (1 if (-m) % 60 else 0)
    r = int(math.fmod(m, 60))
    return f"{h}h {r}m" if h > 0 else f"{r}m"


def _pg_round_ratio(n: int, d: int):
    if d <= 0:
        return None
    q = Fraction(abs(n), d)
    r = math.floor(q + Fraction(1, 2))
    return r if n >= 0 else -r


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-10_000, 10_000)), min_size=1, max_size=40))
def test_fmt_minutes_matches_js(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "m bigint")
    got = [r[0] for r in df.select(X.fmt_minutes(F.col("m"))).collect()]
    assert got == [_fmt(v) for v in values]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(-10**15, 10**15), st.integers(0, 10**6)), min_size=1, max_size=40))
def test_round_ratio_exact(spark, pairs):
    df = spark.createDataFrame([(str(n), d) for n, d in pairs], "n string, d bigint")
    got = [r[0] for r in df.select(X.round_ratio(F.col("n").cast("decimal(38,0)"), F.col("d"))).collect()]
    assert got == [_pg_round_ratio(n, d) for n, d in pairs]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**12), st.integers(-10**9, 10**9)), min_size=1, max_size=40))
def test_rounded_minutes_matches_js(spark, pairs):
    df = spark.createDataFrame(pairs, "a bigint, delta bigint").select(
        F.timestamp_millis(F.col("a")).alias("a"), F.timestamp_millis(F.col("a") + F.col("delta")).alias("b"))
    got = [r[0] for r in df.select(X.rounded_minutes_nonneg(F.col("a"), F.col("b"))).collect()]

    def js(delta):
        m = _js_round(delta / 60000)
        return m if m >= 0 else None
    assert got == [js(d) for _, d in pairs]
