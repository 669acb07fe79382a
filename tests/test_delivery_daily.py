"""R11-R16, R18, R20-R22 semantics on hand-made rows."""

import datetime as dt

from ledgerlens.operators import daily, delivery
from ledgerlens.plans import base as B
from tests.star import D, TS, party, rows, star, voucher

AS_OF = D(2024, 3, 10)
DAY = D(2024, 3, 5)


def _ev(doc, status, at, by):
    return {"document_id": doc, "new_status": status, "changed_at": at, "changed_by": by}


def test_milestones_actor_selection(spark):
    t0 = TS(2024, 3, 5, 10, 0)
    hist = [_ev(11, "Delivered", t0, 99),                              # unknown user, earliest
            _ev(12, "delivered", t0 + dt.timedelta(hours=1), 2),       # user U
            _ev(21, "delivered", t0, 3),                               # user with NULL name
            _ev(21, "IN_TRANSIT", t0 - dt.timedelta(hours=1), 4),      # shipper S
            _ev(11, "packed", t0 - dt.timedelta(hours=5), None)]
    ch = [{"id": 11, "related_invoice_voucher_id": 1}, {"id": 12, "related_invoice_voucher_id": 1},
          {"id": 21, "related_invoice_voucher_id": 2}]
    users = [{"id": 2, "full_name": "U"}, {"id": 3, "full_name": None}, {"id": 4, "full_name": "S"}]
    t = star(spark, document_status_history=hist, delivery_challans=ch, users=users)
    got = {r["voucher_id"]: r for r in rows(B.milestones(t))}
    assert got[1]["delivered_at"] == t0 and got[1]["delivered_by"] == "U" and got[1]["delivery_person"] == "U"
    assert got[1]["packed_at"] == t0 - dt.timedelta(hours=5) and got[1]["shipped_at"] is None
    assert got[2]["delivered_by"] is None and got[2]["delivery_person"] == "S"


def _board_star(spark):
    created = TS(2024, 3, 9, 8, 0)
    vs = [voucher(1, party_id=1, transaction_date=D(2024, 3, 9), created_at=created, delivery_status=""),
          voucher(2, party_id=1, transaction_date=D(2024, 3, 9), delivery_status=" Delivered "),
          voucher(3, party_id=1, transaction_date=D(2024, 3, 8), delivery_status="IN_TRANSIT"),
          voucher(4, party_id=1, transaction_date=D(2024, 3, 8), delivery_status="weird"),
          voucher(5, party_id=1, transaction_date=AS_OF, delivery_status="delivered"),   # today: shown
          voucher(6, party_id=1, transaction_date=D(2024, 3, 9), delivery_status="Delivered"),  # hidden
          voucher(7, party_id=1, transaction_date=D(2024, 3, 8), delivery_status="Packed"),
          voucher(8, party_id=2, transaction_date=D(2024, 3, 9)),        # NULL group: dropped
          voucher(9, party_id=1, transaction_date=D(2024, 2, 1))]        # too old
    ps = [party(1, responsible_party_id=3), party(2, party_group_id=None), party(3, name="Rep")]
    hist = [_ev(11, "packed", created - dt.timedelta(seconds=30), 1),          # -30 s -> 0
            _ev(11, "shipped", created - dt.timedelta(seconds=61), 1),         # packed->shipped -31 s -> NULL
            _ev(11, "delivered", created + dt.timedelta(seconds=29), 1),       # shipped->delivered +90 s -> 2
            _ev(71, "packed", TS(2024, 3, 8, 12, 0), 1)]
    ch = [{"id": 11, "related_invoice_voucher_id": 1}, {"id": 71, "related_invoice_voucher_id": 7}]
    return star(spark, vouchers=vs, parties=ps, document_status_history=hist, delivery_challans=ch,
                users=[{"id": 1, "full_name": "Driver"}])


def test_r11_board_filter_status_sort_durations(spark):
    got = rows(delivery.delivery_board(_board_star(spark), AS_OF))
    # ' Delivered ' passes the (untrimmed) open filter and ranks 0, shown as Delivered
    assert [(r["id"], r["delivery_status"]) for r in got] == [
        (1, "Pending"), (2, "Delivered"), (3, "Shipped"), (4, "weird"), (7, "Packed"), (5, "Delivered")]
    first = got[0]
    assert (first["pending_to_packed_min"], first["packed_to_shipped_min"], first["shipped_to_delivered_min"],
            first["total_delivery_minutes"]) == (0, None, 2, 0)
    assert first["salesperson_name"] == "Rep" and first["is_today"] is False
    assert first["current_status_since"] == first["created_at"]  # Pending -> created
    packed = got[4]
    assert packed["current_status_since"] == TS(2024, 3, 8, 12, 0)
    assert got[5]["is_today"] is True


def _ops_star(spark, extra_vouchers=()):
    p0 = TS(2024, 3, 5, 9, 0)
    vs = [voucher(1, transaction_date=DAY, delivery_status="delivered"),
          voucher(2, transaction_date=DAY, delivery_status=None),
          voucher(3, transaction_date=DAY, is_cancelled=True, voucher_type_id=2, delivery_status="Delivered"),
          *extra_vouchers]
    hist = [_ev(11, "packed", p0, 1), _ev(11, "shipped", p0 + dt.timedelta(minutes=10), 1),
            _ev(21, "packed", p0, 2), _ev(21, "in_transit", p0 + dt.timedelta(minutes=40), 2),
            _ev(31, "in_transit", p0, 1), _ev(31, "shipped", p0, 2)]
    ch = [{"id": 11, "related_invoice_voucher_id": 1}, {"id": 12, "related_invoice_voucher_id": 1},
          {"id": 21, "related_invoice_voucher_id": 2}, {"id": 31, "related_invoice_voucher_id": 3}]
    users = [{"id": 1, "full_name": "Ann"}, {"id": 2, "full_name": "Bo"}]
    return star(spark, vouchers=vs, document_status_history=hist, delivery_challans=ch, users=users)


def test_r20_weighting_and_no_cancel_filter(spark):
    t = _ops_star(spark)
    got = rows(delivery.delivery_operations(t, DAY, DAY))
    assert len(got) == 1
    r = got[0]
    # A: 10 min x 2 challans, B: 40 min x 1 -> (20 + 40) / 3 = 20 (T9); cancelled receipt counted
    assert (r["total"], r["delivered"], r["avg_packed_to_shipped_min"], r["packed_to_shipped"]) == (3, 2, 20, "20m")
    assert r["avg_end_to_end_min"] is None and r["end_to_end"] is None
    dedup = rows(delivery.delivery_operations(t, DAY, DAY, dedupe=True))[0]
    assert dedup["avg_packed_to_shipped_min"] == 25


def test_r13_r21_count_cancelled_r12_does_not(spark):
    t = _ops_star(spark)
    assert rows(delivery.delivery_counts(t, DAY, DAY)) == [{"report_date": DAY, "delivered": 2, "delivery_total": 3}]
    agents = rows(delivery.delivery_agents(t, DAY, DAY))
    assert [(r["agent_name"], r["order_count"]) for r in agents] == [("Ann", 2), ("Bo", 2)]
    hero = rows(daily.daily_hero(t, DAY, DAY))
    assert hero == [{"report_date": DAY, "revenue": 200.0, "invoice_count": 2, "collections": 0.0,
                     "receipt_count": 0}]


def test_r14_percent_and_rollup(spark):
    vs = [voucher(1, transaction_date=DAY, party_id=1, total_amount=100),
          voucher(2, transaction_date=DAY, party_id=2, site_id=4, total_amount=200),
          voucher(3, transaction_date=DAY, party_id=3, site_id=4, total_amount=0)]
    ps = [party(1), party(2, party_group_id=None), party(3, party_group_id=3)]
    t = star(spark, vouchers=vs, parties=ps)
    sites = rows(daily.site_revenue(t, DAY, DAY))
    assert [(s["site_id"], s["total_revenue"], s["revenue_pct"]) for s in sites] == [(1, 100.0, 33.3), (4, 200.0, 66.7)]
    south = sites[1]
    assert [b["party_group"] for b in south["breakdown"]] == ["Other", "Wholesale"]
    assert south["invoice_count"] == sum(b["invoice_count"] for b in south["breakdown"]) == 2


def test_r14_zero_hero_revenue_gives_zero_percent(spark):
    t = star(spark, vouchers=[voucher(1, transaction_date=DAY, party_id=1, total_amount=0)], parties=[party(1)])
    assert rows(daily.site_revenue(t, DAY, DAY))[0]["revenue_pct"] == 0.0


def test_r15_salesmen_keep_null_group_and_unassigned(spark):
    vs = [voucher(1, transaction_date=DAY, party_id=1, total_amount=10),
          voucher(2, transaction_date=DAY, party_id=2, total_amount=20),
          voucher(3, transaction_date=DAY, party_id=3, total_amount=30),   # group 4 excluded
          voucher(4, transaction_date=DAY, party_id=4, total_amount=40)]
    ps = [party(1, responsible_party_id=9), party(2, party_group_id=None), party(3, party_group_id=4),
          party(4, responsible_party_id=9), party(9, name="Rep")]
    got = rows(daily.salesman_revenue(star(spark, vouchers=vs, parties=ps), DAY, DAY))
    assert [(r["salesperson"], r["revenue"]) for r in got] == [("Rep", 50.0), ("Unassigned", 20.0)]


def test_r16_collections(spark):
    vs = [voucher(1, transaction_date=DAY, voucher_type_id=2, total_amount=5),
          voucher(2, transaction_date=DAY, voucher_type_id=2, site_id=4, total_amount=9)]
    got = rows(daily.collections_by_site(star(spark, vouchers=vs), DAY, DAY))
    assert [(r["site_id"], r["collections"], r["receipt_count"]) for r in got] == [(4, 9.0, 1), (1, 5.0, 1)]


def test_r18_null_revenue_first_and_names_merged(spark):
    vs = [voucher(1, transaction_date=DAY)]
    items = [{"id": i, "name": f"item{i}"} for i in range(1, 7)] + [{"id": 7, "name": "item1"},
                                                                   {"id": 8, "name": "ghost"}]
    lines = [{"voucher_id": 1, "item_id": i, "quantity": 1.5, "total_amount": 10 * i} for i in range(1, 8)]
    lines.append({"voucher_id": 1, "item_id": 8, "quantity": 2.5, "total_amount": None})
    got = rows(daily.top_products(star(spark, vouchers=vs, items=items, voucher_items=lines), DAY, DAY))
    assert [(r["rank"], r["name"], r["units"], r["revenue"]) for r in got] == [
        (1, "ghost", 3, 0.0), (2, "item1", 3, 80.0), (3, "item6", 2, 60.0), (4, "item5", 2, 50.0),
        (5, "item4", 2, 40.0)]


def test_r22_composite_empty_day_and_sections(spark):
    t = _ops_star(spark)
    got = rows(daily.daily_report(t, D(2024, 3, 4), DAY))
    assert [r["date"] for r in got] == [D(2024, 3, 4), DAY]
    empty, day = got
    assert empty["revenue"] == 0.0 and empty["delivery_total"] == 0 and empty["sites"] == []
    assert empty["top_products"] == [] and empty["outstanding"]["total"] == 0.0
    assert day["invoice_count"] == 2 and day["delivered"] == 2 and day["delivery_total"] == 3
    ops = day["delivery_by_site"]
    assert [o["site_id"] for o in ops] == [1]
    assert [a["name"] for a in ops[0]["agents"]] == ["Ann", "Bo"]


def test_r22_batch_equals_single_days(spark):
    vs = [voucher(i, transaction_date=D(2024, 3, 1 + i % 3), party_id=1 + i % 2, site_id=1 if i % 2 else 4,
                  voucher_type_id=1 if i % 4 else 2, total_amount=i) for i in range(1, 13)]
    t = star(spark, vouchers=vs, parties=[party(1), party(2, party_group_id=3)])
    batch = {r["date"]: r for r in rows(daily.daily_report(t, D(2024, 3, 1), D(2024, 3, 3)))}
    for d in (D(2024, 3, 1), D(2024, 3, 2), D(2024, 3, 3)):
        single = rows(daily.daily_report(t, d, d))
        assert single == [batch[d]]


def test_r22_single_day_always_one_row(spark):
    t = _ops_star(spark)
    got = rows(daily.daily_report_for_day(t, D(2030, 1, 1)))
    assert len(got) == 1 and got[0]["revenue"] == 0.0 and got[0]["delivery_by_site"] == []
    assert got[0]["outstanding"]["total"] == 0.0


def test_r22_nested_new_customers_in_creation_order(spark):
    ps = [party(1, created_at=TS(2024, 3, 5, 6, 0), name="Late"),
          party(2, created_at=TS(2024, 3, 5, 1, 0), name="Early"),
          party(3, created_at=TS(2024, 3, 5, 3, 0), party_group_id=4)]
    t = star(spark, parties=ps, vouchers=[voucher(1, transaction_date=DAY)])
    got = rows(daily.daily_report(t, DAY, DAY, nest_new_customers=True))[0]
    assert got["new_customer_count"] == 2
    assert [c["customer_name"] for c in got["new_customers"]] == ["Early", "Late"]
    assert list(got)[10:12] == ["new_customers", "top_products"]
