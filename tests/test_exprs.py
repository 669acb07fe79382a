"""Scalar rules: JS / PostgreSQL rounding, status normalisation, durations."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerlens.functions import exprs as X


def _eval(spark, values, fn, typ):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_fmt_minutes(spark):
    got = _eval(spark, [-65, -5, 0, 59, 60, 125, None], X.fmt_minutes, "bigint")
    assert got == ["-5m", "-5m", "0m", "59m", "1h 0m", "2h 5m", None]


def test_normalize_status(spark):
    vals = ["", " Delivered ", "IN_TRANSIT", "weird", None, " packed ", "   ", "fully_delivered", "Pending"]
    got = _eval(spark, vals, X.normalize_status, "string")
    assert got == ["Pending", "Delivered", "Shipped", "weird", "Pending", "Packed", "   ", "Delivered", "Pending"]


def test_status_rank_unknown_and_transit_rank_zero(spark):
    got = _eval(spark, [None, "pending", "Packed", "shipped", "in_transit", "DELIVERED", "partially_delivered", "x"],
                X.status_rank, "string")
    assert got == [0, 0, 1, 2, 0, 3, 3, 0]


def test_rounded_minutes_nonneg(spark):
    base = dt.datetime(2024, 1, 1, 12, 0, 0)
    rows = [(base, base - dt.timedelta(seconds=30)), (base, base - dt.timedelta(seconds=31)),
            (base, base + dt.timedelta(seconds=90)), (base, None), (None, base),
            (base, base + dt.timedelta(seconds=29, milliseconds=999))]
    df = spark.createDataFrame(rows, "a timestamp, b timestamp")
    got = [r[0] for r in df.select(X.rounded_minutes_nonneg(F.col("a"), F.col("b"))).collect()]
    assert got == [0, None, 2, None, None, 0]


def test_round_ratio_half_away_from_zero(spark):
    rows = [(5, 2), (-5, 2), (7, 3), (1, 2), (0, 3), (4, 0), (None, 2)]
    df = spark.createDataFrame([(str(a) if a is not None else None, b) for a, b in rows], "a string, b bigint")
    got = [r[0] for r in df.select(X.round_ratio(F.col("a").cast("decimal(38,0)"), F.col("b"))).collect()]
    assert got == [3, -3, 2, 1, 0, None, None]


def test_round_mean_minutes_exact_tie(spark):
    # 2.5 minutes rounds to 3 (T1); 149.999999 s is 2.49999998 min -> 2
    df = spark.createDataFrame([(150_000_000, 1), (149_999_999, 1), (-150_000_000, 1)], "s bigint, n bigint")
    got = [r[0] for r in df.select(X.round_mean_minutes(F.col("s").cast("decimal(20,0)"), F.col("n"))).collect()]
    assert got == [3, 2, -3]


def test_aging_bucket_edges(spark):
    got = _eval(spark, [-1, 30, 31, 60, 61, 90, 91, None], X.aging_bucket, "int")
    assert got == ["0-30", "0-30", "31-60", "31-60", "61-90", "61-90", "90+", "90+"]


def test_js_round_ties_up(spark):
    got = _eval(spark, [2.5, -2.5, 0.49, -0.5, 333.25], X.js_round, "double")
    assert got == [3, -2, 0, 0, 333]


def test_local_date_and_hour_ignore_session_zone(spark):
    ts = dt.datetime(2024, 1, 1, 20, 0, tzinfo=dt.timezone.utc)
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            df = spark.range(1).select(F.lit(ts).alias("ts"))
            r = df.select(X.local_date(F.col("ts"), "Asia/Kolkata").alias("d"),
                          X.local_hour(F.col("ts"), "Asia/Kolkata").alias("h")).first()
            assert r.d == dt.date(2024, 1, 2) and r.h == 1, zone
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_money_or_zero(spark):
    got = _eval(spark, [None, float("nan"), 1.5], X.money_or_zero, "double")
    assert got == [0.0, 0.0, 1.5]
