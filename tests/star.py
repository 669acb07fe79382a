"""Tiny hand-made star schemas for semantic tests (FIXTURES.md §3)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from ledgerlens.sources.schemas import STAR_SCHEMAS
from ledgerlens.sources.tables import Tables

D = dt.date
TS = dt.datetime

DEFAULT_ROWS = {
    "voucher_types": [{"id": 1, "code": "SINV"}, {"id": 2, "code": "RCT"}],
    "sites": [{"id": 1, "name": "North"}, {"id": 4, "name": "South"}, {"id": 2, "name": "Elsewhere"}],
    "party_groups": [{"id": 1, "name": "Retail"}, {"id": 2, "name": "Corporate"},
                     {"id": 3, "name": "Wholesale"}, {"id": 4, "name": "Purchase"}],
}

VOUCHER_DEFAULTS = {
    "voucher_number": None, "organization_id": 2, "voucher_type_id": 1, "party_id": None, "site_id": 1,
    "transaction_date": D(2024, 3, 10), "created_at": None, "total_amount": Decimal("100.00"),
    "amount_due": Decimal("0.00"), "payment_status": "Paid", "delivery_status": None, "is_cancelled": False,
}
PARTY_DEFAULTS = {
    "organization_id": 2, "site_id": 1, "name": None, "phone": None, "geo_location": None,
    "party_group_id": 1, "responsible_party_id": None, "created_at": None,
}


def _money(v):
    return None if v is None else Decimal(str(v)).quantize(Decimal("0.01"))


def voucher(id, **kw):
    row = dict(VOUCHER_DEFAULTS, id=id, **kw)
    row["voucher_number"] = row["voucher_number"] or f"V{id:05d}"
    if row["created_at"] is None and row["transaction_date"] is not None:
        d = row["transaction_date"]
        row["created_at"] = TS(d.year, d.month, d.day, 9, 0)
    row["total_amount"] = _money(row["total_amount"])
    row["amount_due"] = _money(row["amount_due"])
    return row


def party(id, name=None, **kw):
    return dict(PARTY_DEFAULTS, id=id, name=f"Customer {id}" if name is None else name, **kw)


def star(spark, **tables) -> Tables:
    frames = {}
    for name, schema in STAR_SCHEMAS.items():
        rows = tables.get(name, DEFAULT_ROWS.get(name, []))
        if name == "voucher_items":
            rows = [dict(r, total_amount=_money(r.get("total_amount")),
                         quantity=None if r.get("quantity") is None else Decimal(str(r["quantity"]))) for r in rows]
        data = [tuple(r.get(f.name) for f in schema.fields) for r in rows]
        frames[name] = spark.createDataFrame(data, schema)
    return Tables.from_frames(frames)


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]
