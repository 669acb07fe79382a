"""R1-R5 semantics on hand-made rows."""

import pytest

from ledgerlens import DEFAULT_PARAMS
from ledgerlens.operators import sales
from tests.star import D, party, rows, star, voucher

AS_OF = D(2024, 3, 10)


def _base(spark):
    vs = [voucher(1, transaction_date=D(2024, 3, 10), total_amount=10, party_id=1),
          voucher(2, transaction_date=D(2024, 3, 10), total_amount=20, site_id=4, party_id=2),
          voucher(3, transaction_date=D(2024, 3, 9), total_amount=5, party_id=3),
          voucher(4, transaction_date=D(2024, 3, 10), total_amount=99, is_cancelled=True, party_id=1),
          voucher(5, transaction_date=D(2024, 3, 10), total_amount=77, voucher_type_id=2, party_id=1),
          voucher(6, transaction_date=D(2024, 3, 10), total_amount=66, site_id=2, party_id=1),
          voucher(7, transaction_date=D(2024, 3, 10), total_amount=55, organization_id=3, party_id=1)]
    ps = [party(1, party_group_id=None), party(2, party_group_id=5), party(3, party_group_id=1)]
    groups = [{"id": 1, "name": "Retail"}, {"id": 5, "name": "Other"}]
    return star(spark, vouchers=vs, parties=ps, party_groups=groups)


def test_r1_summary_labels_and_filters(spark):
    got = rows(sales.sales_summary(_base(spark), AS_OF))
    assert got == [
        {"label": "Today", "transaction_date": D(2024, 3, 10), "invoice_count": 2, "sales": 30.0},
        {"label": "Yesterday", "transaction_date": D(2024, 3, 9), "invoice_count": 1, "sales": 5.0},
    ]


def test_r3_by_site_sorted(spark):
    got = rows(sales.sales_by_site(_base(spark), AS_OF))
    assert [(r["period"], r["site_id"], r["site_name"], r["total_amount"]) for r in got] == [
        ("today", 1, "North", 10.0), ("today", 4, "South", 20.0), ("yesterday", 1, "North", 5.0)]


def test_r4_null_group_and_real_other_stay_separate(spark):
    got = rows(sales.sales_by_group(_base(spark), AS_OF))
    today = [(r["group_name"], r["total_amount"]) for r in got if r["period"] == "today"]
    assert today == [("Other", 20.0), ("Other", 10.0)]  # T6: two rows, revenue desc


def test_r2_monthly_window_and_pivot(spark):
    vs = [voucher(1, transaction_date=D(2023, 4, 30)), voucher(2, transaction_date=D(2023, 4, 1), site_id=4),
          voucher(3, transaction_date=D(2023, 3, 31)), voucher(4, transaction_date=D(2024, 5, 1), site_id=4)]
    got = rows(sales.monthly_sales(star(spark, vouchers=vs), AS_OF))
    assert got == [
        {"month": D(2023, 4, 1), "sales_site_1": 100.0, "sales_site_4": 100.0, "total_sales": 200.0},
        {"month": D(2024, 5, 1), "sales_site_1": 0.0, "sales_site_4": 100.0, "total_sales": 100.0},
    ]


def test_r5_bounds_inclusive_and_week_starts_monday(spark):
    vs = [voucher(1, transaction_date=D(2024, 3, 6)),   # Wednesday = from
          voucher(2, transaction_date=D(2024, 3, 12)),  # = to
          voucher(3, transaction_date=D(2024, 3, 13)),  # after
          voucher(4, transaction_date=D(2024, 3, 5))]   # before
    t = star(spark, vouchers=vs)
    daily = rows(sales.sales_trend(t, "2024-03-06", "2024-03-12", "daily"))
    assert [r["date"] for r in daily] == [D(2024, 3, 6), D(2024, 3, 12)]
    weekly = rows(sales.sales_trend(t, "2024-03-06", "2024-03-12", "weekly"))
    assert [(r["date"], r["total_sales"]) for r in weekly] == [(D(2024, 3, 4), 100.0), (D(2024, 3, 11), 100.0)]


def test_r5_exclusion_is_inner_join_and_keeps_null_group(spark):
    vs = [voucher(1, party_id=None), voucher(2, party_id=1), voucher(3, party_id=2), voucher(4, party_id=3)]
    ps = [party(1, party_group_id=2), party(2, party_group_id=None), party(3, party_group_id=1)]
    t = star(spark, vouchers=vs, parties=ps)
    plain = rows(sales.sales_trend(t, "2024-03-01", "2024-03-31", "monthly"))
    assert plain[0]["total_sales"] == 400.0
    excl = rows(sales.sales_trend(t, "2024-03-01", "2024-03-31", "monthly", exclude_corporate=True))
    assert excl[0]["total_sales"] == 200.0  # NULL party (T7) and corporate dropped; NULL group kept (T3)


def test_r5_validation(spark):
    t = star(spark)
    with pytest.raises(ValueError):
        sales.sales_trend(t, "2024-01-01", "2024-02-01", "hourly")
    with pytest.raises(ValueError):
        sales.sales_trend(t, None, "2024-02-01")


def test_pivot_follows_params(spark):
    from dataclasses import replace
    p = replace(DEFAULT_PARAMS, site_pivot={"north": 1})
    got = rows(sales.monthly_sales(star(spark, vouchers=[voucher(1), voucher(2, site_id=4)]), AS_OF, p))
    assert got == [{"month": D(2024, 3, 1), "north": 100.0, "total_sales": 200.0}]
