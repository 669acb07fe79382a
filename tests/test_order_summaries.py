"""R9 from stored months: equal to R9 over the vouchers after any additions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import customers
from ledgerlens.operators import order_summaries as S
from tests.star import D, TS, party, rows, star, voucher

AS_OF = D(2024, 6, 20)
SITES = [{"id": 1, "name": "North"}, {"id": 4, "name": "North"}, {"id": 2, "name": "South"}]


def _vouchers(seed, n=160, first=1):
    """Orders of a few days' distance; one customer holds a third of all."""
    r = random.Random(seed)
    out = []
    for i in range(first, first + n):
        day = None if r.random() < 0.004 else D(2023, 11, 1) + dt.timedelta(days=r.choice([r.randrange(233), 10 * r.randrange(23)]))
        created = None if r.random() < 0.1 or day is None else TS(day.year, day.month, day.day, r.randrange(24))
        out.append(voucher(i, party_id=1 if r.random() < 0.34 else r.choice([None, *range(2, 12)]), site_id=r.choice([1, 4, 2, 9]),
                           transaction_date=day, created_at=created, total_amount=r.choice([None, r.randrange(1000)]),
                           is_cancelled=r.random() < 0.05, voucher_type_id=r.choice([1, 1, 1, 2])))
    return out


def _star(spark, vs):
    ps = [party(i, phone="", responsible_party_id=1 if i % 2 else None, party_group_id=3 if i == 5 else 1) for i in range(1, 12)]
    return star(spark, vouchers=vs, parties=ps, sites=SITES)


def _key(rs):
    return sorted(rs, key=lambda r: r["party_id"])


def _same(spark, t, segments):
    expected = _key(rows(customers.followup_customers(t, AS_OF)))
    assert _key(rows(S.followup_from(t, segments, AS_OF))) == expected
    return expected


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_any_grouping_gives_the_report(spark, seed):
    t = _star(spark, _vouchers(seed))
    days = S.day_segments(t)
    assert len(_same(spark, t, days)) > 3
    _same(spark, t, S.month_segments(t))
    half = F.when(F.col("period") < F.lit(D(2024, 2, 11)), F.lit(D(2023, 1, 1))).otherwise(F.trunc("period", "WEEK"))
    _same(spark, t, S.merged(S.merged(days, F.trunc("period", "WEEK")), half))


def test_months_follow_new_and_lost_vouchers(spark, tmp_path):
    path, vs = str(tmp_path / "months"), _vouchers(4)
    S.create(_star(spark, vs), path)
    more = _vouchers(5, 12, first=1000)
    t = _star(spark, vs + more)
    added = t.vouchers.filter("id >= 1000")
    S.refresh(t, path, S.touched_months(added))
    _same(spark, t, S.stored(spark, path))

    emptied = D(2024, 3, 1)  # every order of a month is cancelled
    t = _star(spark, [dict(v, is_cancelled=True) if v["transaction_date"] and v["transaction_date"].replace(day=1) == emptied else v for v in vs + more])
    kept = {f.name: f.stat().st_mtime_ns for d in (tmp_path / "months").glob("period=2024-02*") for f in d.iterdir()}
    for _ in range(2):  # a repeated run changes nothing
        S.refresh(t, path, [D(2024, 3, 17)])
    assert {f.name: f.stat().st_mtime_ns for d in (tmp_path / "months").glob("period=2024-02*") for f in d.iterdir()} == kept
    _same(spark, t, S.stored(spark, path))
    assert S.stored(spark, path).filter(F.col("period") == F.lit(emptied)).count() == 0
    S.refresh(t, path, [])


def test_undated_orders_drop_their_customer(spark, tmp_path):
    vs = [voucher(i, party_id=1 + i % 2, transaction_date=D(2024, 6, i)) for i in range(1, 9)]
    t, path = _star(spark, vs), str(tmp_path / "months")
    S.create(t, path)
    assert len(_same(spark, t, S.stored(spark, path))) == 2
    t = _star(spark, [*vs, voucher(50, party_id=1, transaction_date=None)])
    S.refresh(t, path, [None])
    assert [r["party_id"] for r in _same(spark, t, S.stored(spark, path))] == [2]


def test_no_orders(spark):
    t = _star(spark, [])
    assert _same(spark, t, S.month_segments(t)) == []


def test_refresh_reads_its_months_and_reports_read_no_voucher(spark, tmp_path):
    t = _star(spark, _vouchers(6))
    t.vouchers.write.parquet(str(tmp_path / "vouchers"))
    S.create(t, str(tmp_path / "months"))
    t.vouchers = spark.read.parquet(str(tmp_path / "vouchers"))
    month = S.month_segments(t, extra=S._among([D(2024, 3, 1)]))
    scan = month._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThanOrEqual(transaction_date,2024-03-01)" in scan and "LessThan(transaction_date,2024-04-01)" in scan
    report = S.followup_from(t, S.stored(spark, str(tmp_path / "months")), AS_OF)
    assert str(tmp_path / "vouchers") not in report._jdf.queryExecution().toString()
