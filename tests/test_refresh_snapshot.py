"""Snapshots of the star schema, and day-wise refresh of stored reports."""

import datetime as dt
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import customers, daily, delivery, refresh
from ledgerlens.sources.sinks import write_report
from ledgerlens.sources.tables import Tables, pinned, read_catalog_tables, read_parquet_tables, read_snapshot, write_parquet_tables, write_snapshot
from tests.star import D, TS, party, rows, star, voucher

DAY = D(2024, 3, 5)


def _event(doc, status, minute, by):
    return {"document_id": doc, "new_status": status, "changed_at": TS(2024, 3, 4, 9) + dt.timedelta(minutes=minute), "changed_by": by}


def _rows(seed, first, n):
    """``n`` vouchers with lines, challans, events and customers, ids from ``first`` on."""
    r = random.Random(seed)
    vs = [voucher(first + i, transaction_date=None if r.random() < 0.05 else D(2024, 3, r.randint(1, 9)), party_id=r.choice([None, *range(1, 30)]),
                  site_id=r.choice([1, 4, 2]), voucher_type_id=r.choice([1, 1, 2]), total_amount=r.randint(0, 90), is_cancelled=r.random() < 0.1,
                  delivery_status=r.choice([None, "Delivered", "Packed"])) for i in range(n)]
    ids = list(range(1, first + n))
    lines = [{"voucher_id": r.choice(ids), "item_id": r.randint(1, 6), "quantity": r.randint(1, 5), "total_amount": r.randint(1, 50)} for _ in range(n)]
    ch = [{"id": first + i, "related_invoice_voucher_id": r.choice([None, *ids[-40:]])} for i in range(n)]
    ev = [_event(r.choice(ids), r.choice(["packed", "shipped", "in_transit", "Delivered", "odd"]), r.randint(0, 3000), r.choice([None, 1, 2, 3, 9])) for _ in range(2 * n)]
    return {"vouchers": vs, "voucher_items": lines, "delivery_challans": ch, "document_status_history": ev}


def _frames(spark, parts):
    merged = {}
    for part in parts:
        for k, v in part.items():
            merged[k] = merged.get(k, []) + v
    return star(spark, items=[{"id": i, "name": f"item{i % 4}"} for i in range(1, 7)], **merged)


def _part(spark, part):
    """Only the rows of ``part``, as the frames that are added."""
    t = star(spark, **part)
    return {k: getattr(t, k) for k in part}


def _people(ids, **kw):
    return [party(i, party_group_id=[None, 1, 2, 3, 4][i % 5], created_at=TS(2024, 3, 1 + i % 9, 22, 0),
                  responsible_party_id=[None, 3, 7, 28][i % 4], **kw) for i in ids]


BASE = [_rows(1, 1, 60), {"parties": _people(range(1, 20)), "users": [{"id": i, "full_name": f"U{i}"} for i in (1, 2)]}]

REPORTS = {"salesmen": daily.salesman_revenue, "newcomers": customers.new_customers, "products": daily.top_products,
           "operations": delivery.delivery_operations, "agents": delivery.delivery_agents}


def _canon(df):
    return sorted((tuple(sorted(r.items(), key=lambda x: x[0])) for r in rows(df)), key=repr)


def _files(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/report_date=*/part-*")}


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_refresh_equals_full_recomputation(spark, tmp_path, name):
    report, path = REPORTS[name], str(tmp_path / name)
    write_report(report(_frames(spark, BASE)), path)
    before = _files(path)
    more = {**_rows(2, 61, 8), "parties": _people(range(20, 30)), "users": [{"id": 3, "full_name": "U3"}]}
    late = ("document_status_history", "delivery_challans")
    steps = [{k: more[k] for k in late}, {k: v for k, v in more.items() if k not in late}]
    for n, part in enumerate(steps, 1):
        held = _frames(spark, [*BASE, *steps[:n]])
        touched = refresh.refresh(report, held, _part(spark, part), path)
        assert _canon(spark.read.parquet(path).select(*report(held).columns)) == _canon(report(held))
        after, days = _files(path), {f"report_date={d or '__HIVE'}" for d in touched}
        assert touched and all(after.get(f) == at for f, at in before.items() if not any(d in f for d in days))
        before = after


def test_touched_days_follow_the_references(spark):
    vs = [voucher(1, transaction_date=D(2024, 3, 1), party_id=1), voucher(2, transaction_date=D(2024, 3, 2), party_id=2), voucher(3, transaction_date=None)]
    ch = [{"id": 10, "related_invoice_voucher_id": 1}, {"id": 20, "related_invoice_voucher_id": 2}, {"id": 30, "related_invoice_voucher_id": None}]
    ev = [_event(10, "packed", 0, 7), _event(20, "packed", 0, 8), _event(30, "packed", 0, 7), _event(99, "packed", 0, 7)]
    ps = [party(1, responsible_party_id=5, created_at=TS(2024, 2, 1, 20, 0)), party(2), party(5, created_at=TS(2024, 2, 2, 1, 0))]
    t = star(spark, vouchers=vs, delivery_challans=ch, document_status_history=ev, parties=ps, users=[{"id": 7, "full_name": "U"}])

    def days(**added):
        return sorted(r[0] for r in refresh.touched_days(t, _part(spark, added)).collect())

    assert days(vouchers=vs[:2]) == [D(2024, 3, 1), D(2024, 3, 2)]
    assert days(vouchers=vs[2:]) == [None]
    assert days(document_status_history=ev[1:]) == [D(2024, 3, 2)]
    assert days(delivery_challans=ch[:1]) == days(users=[{"id": 7, "full_name": "U"}]) == [D(2024, 3, 1)]
    assert days(voucher_items=[{"voucher_id": 2, "item_id": 1}, {"voucher_id": None, "item_id": 1}]) == [D(2024, 3, 2)]
    assert days(parties=ps[2:]) == [D(2024, 2, 2), D(2024, 3, 1)]  # a representative: the customers that name it, too
    assert days(parties=ps[1:2]) == [D(2024, 3, 2)]
    assert days(document_status_history=[]) == []
    with pytest.raises(ValueError):
        refresh.touched_days(t, {"sites": t.sites})


def test_refresh_of_the_composite(spark, tmp_path):
    path, base = str(tmp_path / "r22"), _frames(spark, BASE)
    sections = ("sites", "salesman_by_site", "collections_by_site", "top_products", "delivery_by_site")

    def report(t, lo=None, hi=None, p=daily.DEFAULT_PARAMS):
        return daily.daily_report(t, lo or D(2024, 3, 1), hi or D(2024, 3, 9), p, sections=sections)

    write_report(report(base), path, partition_by=["date"])
    part = _rows(3, 61, 4)
    held = _frames(spark, [*BASE, part])
    assert refresh.refresh(report, held, _part(spark, part), path, day="date")
    assert _canon(spark.read.parquet(path).select(*report(held).columns)) == _canon(report(held))
    assert refresh.refresh(report, held, _part(spark, {"vouchers": []}), path, day="date") == []


# ---------------------------------------------------------------- snapshots
def _stored(spark, tmp_path, **kw):
    root = str(tmp_path / "star")
    write_parquet_tables(_frames(spark, BASE), root, **kw)
    return root


def _one_more(spark):
    return star(spark, vouchers=[voucher(900, transaction_date=DAY, total_amount=777)]).vouchers


@pytest.mark.parametrize("by_date", [False, True])
def test_a_built_report_does_not_see_later_files(spark, tmp_path, by_date):
    root = _stored(spark, tmp_path, partition_vouchers_by_date=by_date)
    t = read_parquet_tables(spark, root)
    report = daily.daily_report(t, DAY, DAY)
    before = report.collect()
    w = _one_more(spark).write.mode("append")
    (w.partitionBy("transaction_date") if by_date else w).parquet(f"{root}/vouchers")
    assert report.collect() == before == daily.daily_report(t, DAY, DAY).collect()
    assert daily.daily_hero(t, DAY, DAY).collect() != daily.daily_hero(read_parquet_tables(spark, root), DAY, DAY).collect()


def test_pinned_tables_do_not_see_an_insert(spark, tmp_path):
    root = _stored(spark, tmp_path)
    for name in Tables.__dataclass_fields__:
        spark.read.parquet(f"{root}/{name}").write.mode("overwrite").option("path", str(tmp_path / "cat" / name)).saveAsTable(f"pin_{name}")
    names = {name: f"pin_{name}" for name in Tables.__dataclass_fields__}
    try:
        t = read_catalog_tables(spark, names=names, pin=True)
        report = daily.daily_hero(t, DAY, DAY)
        before = report.collect()
        _one_more(spark).write.insertInto("pin_vouchers")
        assert report.collect() == before
        assert daily.daily_hero(read_catalog_tables(spark, names=names, pin=True), DAY, DAY).collect() != before
    finally:
        for name in names.values():
            spark.sql(f"DROP TABLE IF EXISTS {name}")


@pytest.mark.parametrize("by_date", [False, True])
def test_a_snapshot_opens_the_noted_state(spark, tmp_path, by_date):
    root = _stored(spark, tmp_path, partition_vouchers_by_date=by_date)
    before = _canon(daily.daily_hero(read_parquet_tables(spark, root)))
    write_snapshot(spark, root, str(tmp_path / "noted"))
    w = _one_more(spark).write.mode("append")
    (w.partitionBy("transaction_date") if by_date else w).parquet(f"{root}/vouchers")
    assert _canon(daily.daily_hero(read_snapshot(spark, str(tmp_path / "noted")))) == before
    assert _canon(daily.daily_hero(read_parquet_tables(spark, root))) != before


def test_pinning_keeps_pushdown_and_empty_tables(spark, tmp_path):
    root = _stored(spark, tmp_path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    try:
        plan = daily.daily_hero(read_parquet_tables(spark, root), DAY, DAY)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(transaction_date" in plan or "EqualTo(transaction_date" in plan
    spark.range(0).write.parquet(str(tmp_path / "none"))
    assert pinned(spark.read.schema("id bigint").parquet(str(tmp_path / "none"))).filter(F.col("id") > 0).collect() == []
