"""Logical input schemas of the accounting-voucher star schema.

The reports read ten tables. Every report function takes them through a
:class:`~ledgerlens.sources.tables.Tables` container, so the loader (Parquet,
catalog table, JDBC or the synthetic adapter) is decided once, and a table
with a missing or mistyped column fails at load time instead of mid-report.
"""

from __future__ import annotations

from pyspark.sql import types as T

_L, _I, _S = T.LongType(), T.IntegerType(), T.StringType()
_D, _TS, _B = T.DateType(), T.TimestampType(), T.BooleanType()
_MONEY, _QUANTITY = T.DecimalType(18, 2), T.DecimalType(18, 3)
_QUANTITY = T.DecimalType(18, 3)


def _schema(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


VOUCHERS = _schema(
    ("id", _L, False),
    ("voucher_number", _S, True),
    ("organization_id", _I, True),
    ("voucher_type_id", _I, True),
    ("party_id", _L, True),
    ("site_id", _I, True),
    ("transaction_date", _D, True),
    ("created_at", _TS, True),
    ("total_amount", _MONEY, True),
    ("amount_due", _MONEY, True),
    ("payment_status", _S, True),
    ("delivery_status", _S, True),
    ("is_cancelled", _B, True),
)

VOUCHER_TYPES = _schema(("id", _I, False), ("code", _S, True))

PARTIES = _schema(
    ("id", _L, False),
    ("organization_id", _I, True),
    ("site_id", _I, True),
    ("name", _S, True),
    ("phone", _S, True),
    ("geo_location", _S, True),
    ("party_group_id", _I, True),
    ("responsible_party_id", _L, True),
    ("created_at", _TS, True),
)

PARTY_GROUPS = _schema(("id", _I, False), ("name", _S, True))
SITES = _schema(("id", _I, False), ("name", _S, True))
ITEMS = _schema(("id", _L, False), ("name", _S, True))

VOUCHER_ITEMS = _schema(
    ("voucher_id", _L, True),
    ("item_id", _L, True),
    ("quantity", _QUANTITY, True),
    ("total_amount", _MONEY, True),
)

DELIVERY_CHALLANS = _schema(("id", _L, False), ("related_invoice_voucher_id", _L, True))

DOCUMENT_STATUS_HISTORY = _schema(
    ("document_id", _L, True),
    ("new_status", _S, True),
    ("changed_at", _TS, True),
    ("changed_by", _L, True),
)

USERS = _schema(("id", _L, False), ("full_name", _S, True))

STAR_SCHEMAS: dict[str, T.StructType] = {
    "vouchers": VOUCHERS,
    "voucher_types": VOUCHER_TYPES,
    "parties": PARTIES,
    "party_groups": PARTY_GROUPS,
    "sites": SITES,
    "items": ITEMS,
    "voucher_items": VOUCHER_ITEMS,
    "delivery_challans": DELIVERY_CHALLANS,
    "document_status_history": DOCUMENT_STATUS_HISTORY,
    "users": USERS,
}
