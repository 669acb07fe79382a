"""R6-R10, R17, R19 semantics on hand-made rows."""

import dataclasses

import pytest

from ledgerlens import DEFAULT_PARAMS
from ledgerlens.operators import customers, receivables
from tests.star import D, TS, party, rows, star, voucher

AS_OF = D(2024, 3, 10)


def test_r6_bucket_edges_and_filters(spark):
    ages = [-1, 30, 31, 60, 61, 90, 91]
    vs = [voucher(i + 1, transaction_date=D.fromordinal(AS_OF.toordinal() - a), payment_status="Unpaid",
                  amount_due=10 * (i + 1)) for i, a in enumerate(ages)]
    vs += [voucher(20, payment_status="Paid", amount_due=5),
           voucher(21, payment_status="Partially Paid", amount_due=-5),
           voucher(22, payment_status="Partially Paid", amount_due=1, transaction_date=None)]
    got = rows(receivables.ar_aging(star(spark, vouchers=vs), AS_OF))
    assert got == [
        {"age_bucket": "0-30", "invoice_count": 2, "outstanding": 30.0},
        {"age_bucket": "31-60", "invoice_count": 2, "outstanding": 70.0},
        {"age_bucket": "61-90", "invoice_count": 2, "outstanding": 110.0},
        {"age_bucket": "90+", "invoice_count": 2, "outstanding": 71.0},
    ]


def test_r7_credits_reduce_balance_and_group_filter(spark):
    vs = [voucher(1, party_id=1, payment_status="Unpaid", amount_due=100, transaction_date=D(2024, 3, 1)),
          voucher(2, party_id=1, payment_status="Unpaid", amount_due=-30, transaction_date=D(2024, 2, 1)),
          voucher(3, party_id=1, payment_status="Paid", transaction_date=D(2024, 3, 5)),
          voucher(4, party_id=2, payment_status="Unpaid", amount_due=50),   # NULL group -> dropped
          voucher(5, party_id=3, payment_status="Unpaid", amount_due=50),   # excluded group
          voucher(6, party_id=4, payment_status="Unpaid", amount_due=-1)]   # not > 0
    ps = [party(1, responsible_party_id=9), party(2, party_group_id=None), party(3, party_group_id=2),
          party(4), party(9, name="")]
    got = rows(receivables.at_risk_customers(star(spark, vouchers=vs, parties=ps), AS_OF))
    assert got == [{"party_id": 1, "customer_name": "Customer 1", "branch": "North", "sales_rep": None,
                    "last_purchase_date": D(2024, 3, 5), "days_inactive": 5, "open_invoice_count": 2,
                    "total_outstanding": 70.0, "oldest_due_date": D(2024, 2, 1)}]


def test_r7_branches_merge_by_name(spark):
    vs = [voucher(1, party_id=1, site_id=1, payment_status="Unpaid", amount_due=10),
          voucher(2, party_id=1, site_id=4, payment_status="Unpaid", amount_due=5)]
    sites = [{"id": 1, "name": "Same"}, {"id": 4, "name": "Same"}]
    got = rows(receivables.at_risk_customers(star(spark, vouchers=vs, parties=[party(1)], sites=sites), AS_OF))
    assert [(r["branch"], r["open_invoice_count"], r["total_outstanding"]) for r in got] == [("Same", 2, 15.0)]


def test_r8_validation_and_any_site(spark):
    vs = [voucher(1, party_id=7, site_id=2, payment_status="Unpaid", amount_due=5, transaction_date=D(2024, 1, 2)),
          voucher(2, party_id=7, payment_status="Partially Paid", amount_due=3, transaction_date=D(2024, 1, 1)),
          voucher(3, party_id=7, payment_status="Unpaid", amount_due=0),
          voucher(4, party_id=8, payment_status="Unpaid", amount_due=9)]
    t = star(spark, vouchers=vs)
    got = rows(receivables.open_invoices(t, 7))
    assert [r["voucher_number"] for r in got] == ["V00002", "V00001"]
    for bad in (0, None, "12abc", True, -3):
        with pytest.raises(ValueError):
            receivables.open_invoices(t, bad)
    both = rows(receivables.open_invoices_for(t, [7, 8]))
    assert [(r["party_id"], r["voucher_number"]) for r in both] == [(7, "V00002"), (7, "V00001"), (8, "V00004")]


def test_r19_and_r6_totals_agree(spark):
    vs = [voucher(i, payment_status="Unpaid", amount_due=i, site_id=1 if i % 2 else 4) for i in range(1, 9)]
    t = star(spark, vouchers=vs)
    by_site = rows(receivables.outstanding_by_site(t))
    assert [r["site_id"] for r in by_site] == [4, 1]
    summary = rows(receivables.outstanding_summary(t))[0]
    aging = rows(receivables.ar_aging(t, AS_OF))
    assert summary["total"] == sum(r["outstanding"] for r in aging) == 36.0
    assert [s["site_id"] for s in summary["by_site"]] == [4, 1]


def _followup(spark, vs, ps=None):
    ps = ps or [party(1, phone="", responsible_party_id=9), party(9, name="")]
    return rows(customers.followup_customers(star(spark, vouchers=vs, parties=ps), AS_OF))


def test_r9_single_order_has_no_prediction(spark):
    got = _followup(spark, [voucher(1, party_id=1, transaction_date=D(2024, 3, 1), created_at=TS(2024, 3, 1, 4, 0))])
    assert got == [{"party_id": 1, "customer_name": "Customer 1", "branch": "North", "sales_rep": None,
                    "phone": None, "last_purchase_date": D(2024, 3, 1), "last_order_amount": 100.0,
                    "total_orders": 1, "avg_cycle_days": None, "usual_order_hour": 9,
                    "predicted_next_order_date": None, "days_until_order": None}]


def test_r9_gaps_cross_branches(spark):
    # day 0 at A, day 10 at B, day 20 at A: only A (latest) is reported with
    # its 2 orders and the one gap credited to it (20 - 10 = 10).
    vs = [voucher(1, party_id=1, site_id=1, transaction_date=D(2024, 2, 10)),
          voucher(2, party_id=1, site_id=4, transaction_date=D(2024, 2, 20)),
          voucher(3, party_id=1, site_id=1, transaction_date=D(2024, 3, 1), total_amount=7)]
    got = _followup(spark, vs)
    assert len(got) == 1
    r = got[0]
    assert (r["branch"], r["total_orders"], r["avg_cycle_days"], r["last_order_amount"]) == ("North", 2, 10, 7.0)
    assert r["predicted_next_order_date"] == D(2024, 3, 11) and r["days_until_order"] == 1


def test_r9_same_day_ties_use_voucher_id(spark):
    vs = [voucher(5, party_id=1, site_id=4, transaction_date=D(2024, 3, 1), total_amount=1),
          voucher(6, party_id=1, site_id=1, transaction_date=D(2024, 3, 1), total_amount=2),
          voucher(4, party_id=1, site_id=1, transaction_date=D(2024, 2, 1), total_amount=3)]
    got = _followup(spark, vs)
    # Latest = id 6 at North; North gaps: id 4 (NULL, first), id 6 (0: same day as id 5) -> mean 0.
    assert [(r["branch"], r["last_order_amount"], r["total_orders"], r["avg_cycle_days"]) for r in got] == [
        ("North", 2.0, 2, 0)]


def test_r9_recent_filter_after_history_and_exclusions(spark):
    vs = [voucher(1, party_id=1, transaction_date=D(2023, 1, 1)),
          voucher(2, party_id=1, transaction_date=D(2024, 2, 15)),
          voucher(3, party_id=2, transaction_date=D(2024, 3, 1)),  # NULL group -> dropped
          voucher(4, party_id=3, transaction_date=D(2024, 1, 1))]  # older than 30 days
    ps = [party(1), party(2, party_group_id=None), party(3)]
    got = _followup(spark, vs, ps)
    assert [(r["party_id"], r["avg_cycle_days"]) for r in got] == [(1, 410)]


def test_r9_name_exclusion(spark):
    p = dataclasses.replace(DEFAULT_PARAMS, exclude_name_like="%kemp%")
    vs = [voucher(1, party_id=1, transaction_date=D(2024, 3, 1)), voucher(2, party_id=2, transaction_date=D(2024, 3, 1))]
    ps = [party(1, name="Anna KEMP"), party(2, name="Bob")]
    got = rows(customers.followup_customers(star(spark, vouchers=vs, parties=ps), AS_OF, p))
    assert [r["customer_name"] for r in got] == ["Bob"]


def test_r10_locations_window_and_blanks(spark):
    vs = [voucher(1, party_id=1, transaction_date=D(2024, 2, 9)),
          voucher(2, party_id=1, transaction_date=D(2024, 2, 8)),
          voucher(3, party_id=1, transaction_date=D(2024, 3, 20), total_amount=1),
          voucher(4, party_id=2, site_id=4, transaction_date=D(2024, 3, 1), total_amount=500)]
    ps = [party(1, geo_location="", phone="+1"), party(2, party_group_id=2, geo_location="12.9,80.2")]
    got = rows(customers.customer_locations(star(spark, vouchers=vs, parties=ps), AS_OF))
    assert [(r["party_id"], r["orders_last_30d"], r["revenue_last_30d"], r["geo_location"], r["last_order_date"])
            for r in got] == [(2, 1, 500.0, "12.9,80.2", D(2024, 3, 1)), (1, 2, 101.0, None, D(2024, 3, 20))]


def test_r17_local_day_groups_and_rep(spark):
    ps = [party(1, created_at=TS(2024, 1, 1, 20, 0), responsible_party_id=9),   # local 2024-01-02
          party(2, created_at=TS(2024, 1, 1, 18, 0), party_group_id=None),       # local 2024-01-01 23:30
          party(3, created_at=TS(2024, 1, 2, 1, 0), party_group_id=4),           # excluded group
          party(4, created_at=TS(2024, 1, 2, 2, 0), site_id=2),                  # not a report site
          party(9, name="Rep Nine", created_at=None)]
    t = star(spark, parties=ps)
    got = rows(customers.new_customers(t, "2024-01-02", "2024-01-02"))
    assert got == [{"report_date": D(2024, 1, 2), "customer_name": "Customer 1", "site_name": "North",
                    "site_id": 1, "added_by": "Rep Nine"}]
    allday = rows(customers.new_customers(t))
    assert [(r["report_date"], r["added_by"]) for r in allday] == [(D(2024, 1, 1), "Unknown"),
                                                                  (D(2024, 1, 2), "Rep Nine")]
